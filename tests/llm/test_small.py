"""Each operator against brute force, a round trip or planted cases; awkward rows; empty tables."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallybook.llm import (chat, context_tree, decontaminate, forest, near_dedup, pii, quality,
                           token_files, toxicity, unigram)
from tallybook.llm.queries import QUERIES

LONG = "river stone " * 20_000
TEXTS = [None, "", "   ", "a", "One two three four five six.", "One two three four five six.",
         "A-Z  tabs\tand\n\nlines ▁ marker  日本 \U0001f600 \x00", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, ties, repeated rows, a long text and extra columns with names the operators use."""
    rows = [(i, t, None, None, None, 1, "x", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(4, TEXTS[4], "en", "s", 28, 1, "x", 0.5), (None, "no id here at all", "en", "s",
                                                         None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long, ids int, key string, score double").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (5, None, 0), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "some item text")],
                                 "item_id long, text string")


def test_every_operator_takes_awkward_and_empty_tables(docs, labels, benchmark):
    def outputs(rows):
        yield decontaminate.contaminated(rows, benchmark), 0
        yield near_dedup.near_duplicates(rows), len(TEXTS) + 2
        yield toxicity.toxicity(rows, labels), len(TEXTS) + 2
        yield unigram.encoded(rows), len(TEXTS) + 2
        yield pii.private(rows), len(TEXTS) + 2
        yield context_tree.scored(rows), len(TEXTS) + 2
        yield token_files.token_output(rows), len(TEXTS) + 2
        yield quality.quality(rows, labels), len(TEXTS) + 2

    for out, n in outputs(docs):
        assert out.count() == n, out.columns
    for out, _ in outputs(docs.limit(0)):
        assert out.count() == 0, out.columns


def test_all_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


def test_chat_round_trip(spark):
    odd = ["", "\\", "\\h", "###", "####", "</turn>", "</turn>\n### user: x</turn>\n", "a:b\\e", "\\\\e"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(["user", "a:b###\\c"], odd))]
    rows += [(2, None, None, None), (None, 0, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical_turns(table)).withColumn(
        "turns", chat.parsed(chat.F.col("formatted"))).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out}
    assert got[1] == [(r, t) for _, _, r, t in rows[:-2]]
    assert got[2] == [("", "")] and got[None] == [("assistant", "y")]


def test_chat_layouts_by_fingerprint(spark):
    records = ['{"prompt":"p","response":"r","more":{"x":1}}', '{"messages":[{"role":"user",'
               '"content":"p"},{"role":"assistant","content":"r"}]}', '{"conversations":[{"from":'
               '"human","value":"p"},{"from":"gpt","value":"r"}]}', '{"odd":1}', "no json", None]
    rows = chat.canonical_json(spark.createDataFrame(list(enumerate(records)),
                                                     "conv_id long, record string")).collect()
    for i in range(3):
        assert sorted((r.turn, r.role, r.text) for r in rows if r.conv_id == i) == [
            (0, "user", "p"), (1, "assistant", "r")]
    assert sorted(r.conv_id for r in rows if r.layout is None) == [3, 4, 5]
    nested = spark.createDataFrame([(1, [("human", "p"), ("gpt", None)])],
                                   "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [(r.role, r.text) for r in chat.canonical_turns(nested).collect()] == [
        ("user", "p"), ("assistant", "")]


def test_unigram_takes_the_best_path():
    pieces = unigram.read_pieces(unigram.vocabulary())
    model = unigram.Unigram(pieces)
    score = {p.decode(): s for p, s, k in pieces if k in (unigram.NORMAL, unigram.USER)}

    def best(chunk):
        total = [0.0] + [-np.inf] * len(chunk)
        for end in range(1, len(chunk) + 1):
            for start in range(end):
                piece = chunk[start:end]
                cost = score.get(piece, model.unknown if len(piece) == 1 else -np.inf)
                total[end] = max(total[end], total[start] + cost)
        return total[-1]

    for chunk in ("▁encyclopaedia", "▁▁▁x", "▁日本語", "▁naïvely", "▁" + "abc" * 30):
        ids, total, k = model.encode_batch([chunk.encode()])[0].tolist(), 0.0, 0
        while k < len(ids):
            piece, s, kind = pieces[ids[k]]
            if kind == unigram.BYTE:
                lead = int(piece[3:5], 16)
                total += model.unknown
                k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            else:
                total += s
                k += 1
        assert total == pytest.approx(best(chunk))
    for text in filter(None, TEXTS):
        assert model.decode(model.encode([text])[0].tolist()) == text


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8)).astype(np.float32)
    v[200:400] = v[200]  # a third of all rows is one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(700, None), (720, []), (740, [0.0] * 8), (760, [float("nan")] * 8),
           (780, [1.0, None] * 4), (800, [1.0] * 3), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    out = forest.nearest(table, leaf=32, share=0.6).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    x, hit = v.astype(float), 0
    for q, found in got.items():
        exact = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -exact)) if i != q][:20]
        hit += len({i for i, _ in found} & set(order))
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in found)
    assert hit / (20 * len(got)) >= 0.9
    assert forest.nearest(table.limit(0)).count() == 0


def test_neighbours_found_grow_with_the_queries_not_with_their_leaves(spark, monkeypatch):
    """All leaves visited: the result is exact, and a block returns only what reaches the bound."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 8))
    x[::2] = x[::2].astype(np.float32)  # half of the rows fit single precision
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                  "vec_id long, embedding array<double>")
    made, real = spark.sparkContext.accumulator(0), forest._best

    def counted(*args):
        out = real(*args)
        made.add(len(out))
        return out

    monkeypatch.setattr(forest, "_best", counted)
    out = forest.nearest(table, k=5, every=40, trees=2, leaf=16, share=1.0).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out}
    exact = {}
    for q in range(0, 1200, 40):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1200), -scores)) if i != q][:5]
        exact |= {(q, n): (i, pytest.approx(scores[i], abs=1e-12)) for n, i in enumerate(order, 1)}
    assert got == exact
    assert made.value < 30 * 250  # 30 queries visit 256 leaves each; 6 rows a leaf would be 46,080


def test_context_tree_equals_the_sequential_mixture(spark):
    """One text learnt, one scored: the batch weights against a recursion written out."""
    learnt, asked = "abracadabra abracadabra", "abra"
    grams = context_tree.windows(learnt)
    counts = {}
    for depth in range(context_tree.DEPTH + 1):
        nodes, bits = context_tree.decisions(grams, depth)
        for n, b in zip(nodes.ravel().tolist(), bits.ravel().tolist()):
            counts.setdefault((depth, n), [0, 0])[b] += 1

    def kt(n0, n1):
        p = 1.0
        for i in range(n0):
            p *= (i + 0.5) / (i + 1)
        for i in range(n1):
            p *= (i + 0.5) / (n0 + i + 1)
        return p

    def below(depth, node):
        out = 1.0
        for (d, n) in counts:
            if d == depth + 1 and context_tree.parent(np.array([n]), d)[0] == node:
                out *= weighted(d, n)
        return out

    def weighted(depth, node):
        own = kt(*counts[depth, node])
        return own if depth == context_tree.DEPTH else (own + below(depth, node)) / 2

    def one(path, depth=0):
        n0, n1 = counts.get((depth, path[depth]), (0, 0))
        if not n0 + n1:
            return 0.5
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if depth == context_tree.DEPTH:
            return own
        stop, go = kt(n0, n1), below(depth, path[depth])
        return (stop * own + go * one(path, depth + 1)) / (stop + go)

    want = 0.0
    for gram in context_tree.windows(asked):
        nodes = [context_tree.decisions(np.array([gram]), d) for d in range(context_tree.DEPTH + 1)]
        for j in range(8):
            p = one([int(n[0][0, j]) for n in nodes])
            want += np.log10(p if nodes[0][1][0, j] else 1 - p)
    ids = sorted(range(50), key=lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    table = spark.createDataFrame([(ids[0], asked), (ids[-1], learnt)], "doc_id long, text string")
    row = {r.doc_id: r for r in context_tree.scored(table).collect()}[ids[0]]
    assert row.held_out and row.n_tokens == 2 and row.n_known == 1 and row.train_tokens == 3
    assert row.score == pytest.approx(want, rel=1e-9)
    assert row.base_score == pytest.approx(np.log10(1 / 6) + np.log10(2 / 6))


def test_context_tree_packs_windows_by_bucket(spark):
    """A chunk is a row and one per bucket, not a row per window; its keys and numbers come back."""
    texts = [f"word{i} and {i * 7919} more, naïve {chr(0x4e00 + i)}" for i in range(400)] + [None, ""]
    ids = [*range(400), None, 401]
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(1)
    rows = context_tree.chunks(table).where("kind is not null").toArrow()
    learnt = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i in ids]
    want = Counter()
    for t, n in zip(texts, learnt):
        want.update({g: 0 for g in context_tree.windows(t).tolist()})
        want.update(context_tree.windows(t).tolist() if n else [])
    assert len(rows) <= 2 * context_tree.BUCKETS < len(want)
    got = {}
    for b in range(context_tree.BUCKETS):
        own = rows.filter([k == context_tree.GRAM and x == b for k, x in zip(
            rows["kind"].to_pylist(), rows["bucket"].to_pylist())])
        keys, n, places = context_tree.merged(own)
        got |= dict(zip(keys.tolist(), n.tolist()))
        assert sum(map(len, places)) == len(keys)
    assert got == want


def test_context_tree_of_several_chunks_equals_one(spark):
    rows = [(i, f"the {i % 7} cats and {i} dogs") for i in range(90)] + [(3, "again"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.score, 9),
                          round(r.base_score, 9)) for r in context_tree.scored(t).collect()))
                 for t in (table.coalesce(1), table.repartition(7)))
    assert one == many and len(one) == 92


def test_token_files_round_trip(tmp_path, docs):
    own = token_files.encoder(token_files.vocabulary())
    texts = [t or "" for t in TEXTS] + ["x <|endoftext|> y", "a\x1cb\x85c", "it's  we'll \n\n 12³"]
    got = own.encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids
    path = str(tmp_path / "one.zst")
    with token_files.fs.LocalFileSystem().open_output_stream(path, compression=None) as out:
        writer = token_files.FrameWriter(out, frame_ids=8)
        for i, ids in enumerate(got):
            writer.add(i, ids)
        writer.close()
    source = token_files.fs.LocalFileSystem().open_input_file(path)
    reader = token_files.FrameReader(source)
    for i in reversed(range(len(got))):
        assert reader.document(i).tolist() == got[i].tolist()
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.starts[1]) - 1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        token_files.FrameReader(token_files.fs.LocalFileSystem().open_input_file(path)).frame(0)
    rows = sorted(token_files.token_output(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 4, 5, 6, 7]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()


def test_near_copies_and_passages_are_found(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "changed ")
    other = " ".join(f"v{i}" for i in range(200))
    item = " ".join(f"q{i}" for i in range(60))
    rows = [(1, base), (2, near), (3, base.upper()), (4, other), (5, other[:300] + " " + item),
            (6, other[:300] + " " + item.replace("q30 ", "x "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == 4
    marked = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, marked).collect()} == {5, 6}


def test_personal_data_by_kind(spark):
    text = "mail a.b@c.de ip 10.0.0.1 card 4111 1111 1111 1111 phone +49 (30) 1234567 ip 999.1.1.1"
    row = pii.private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert all(r.exact for r in out) and 0 < len(out) < docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_terms_are_judged_on_pooled_evidence(spark):
    """A name beside four addresses, each in one text, and a word that stands everywhere."""
    plain = [f"common words of text number{i} without anything else" for i in range(60)]
    held = [f"common Zorblax mail person{i}@host{i}.org here" for i in range(4)]
    once = ["common Onlyhere mail other@host9.org"]
    docs = spark.createDataFrame(list(enumerate(plain + held + once)), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.private(docs).collect()}
    for i, text in enumerate(held, len(plain)):
        assert "term:7:14" in out[i].split(",") and "term:0:6" not in out[i], out[i]
    assert not any(out[i] for i in range(len(plain)))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert all("Zorblax" not in t for t in clean.values())


def test_items_with_few_substitutions_are_held_wherever_these_lie():
    for n in range(15, 21):
        item = np.arange(1, n + 1).astype(np.uint64)
        own = list(decontaminate.masked_hashes(item))
        for places in itertools.chain.from_iterable(
                itertools.combinations(range(n), k) for k in (1, 2, 3)):
            doc = item.copy()
            doc[list(places)] += np.uint64(1000)
            assert any((a == b).any() for a, b in zip(own, decontaminate.masked_hashes(doc))), places
            equal, start, words = decontaminate.judged(doc, item, [0])
            assert equal >= 12 and equal == int((doc == item)[start:start + words].sum())


def test_the_stretch_of_an_identity_has_the_most_equal_words():
    rng = np.random.default_rng(4)
    for _ in range(300):
        item, doc = (rng.integers(0, 3, n).astype(np.uint64) for n in rng.integers(1, 25, 2))
        diagonal, identity = int(rng.integers(-5, 15)), float(rng.choice([0.75, 0.8, 0.9]))
        low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        same = [int(doc[i + diagonal] == item[i]) for i in range(low, high)]
        want = max((sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                    if sum(same[a:b]) >= identity * (b - a)), default=0)
        equal, start, n = decontaminate.longest_stretch(doc, item, diagonal, identity)
        assert equal == want and equal >= identity * n


def test_terms_are_marked_wherever_they_stand_in_texts_with_the_entity(spark):
    """A name that never stands within eight words of the address, and stands twice in one text."""
    fill = " ".join(f"filler{i}" for i in range(20))
    plain = [f"{fill} common mail number{i}" for i in range(60)]
    held = [f"Zorblax {fill} mail person{i}@host{i}.org {fill} (Zorblax)" for i in range(4)]
    rows = list(enumerate(plain + held + held[:1])) + [(60, held[0]), (None, held[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.private(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.n_email:
            end = max(len(t) for t in held)
            assert r.spans.split(",")[1:] == ["term:0:7", f"term:{end - 9}:{end}"], r.spans
        else:
            assert r.spans == ""
    clean = pii.sanitised(docs).collect()
    assert len(clean) == len(rows) and not any("Zorblax" in r.text for r in clean)


def test_chat_layouts_with_clashing_columns_and_null_fields(spark):
    rows = "conv_id long, turn long, role string, text string"
    for extra in ("prompt string, response string", "prompt string", "input string",
                  "output string", "messages array<struct<role:string,content:string>>"):
        table = spark.createDataFrame([(1, 0, "user", "hello") + (None,) * (extra.count(" string, ") + 1)],
                                      f"{rows}, {extra}")
        assert [tuple(r) for r in chat.canonical_turns(table).collect()] == [(1, 0, "user", "hello")]
    records = ['{"prompt":"p","response":null}',
               '{"messages":[{"role":"user","content":null},{"role":"assistant","content":"r"}]}',
               '{"messages":[{"role":"user"},{"role":"assistant","content":"r"},"odd"]}',
               '{"prompt":"p","response":"r","output":"o"}',
               '{"instruction":"i","input":null,"output":"o"}',
               '{"instruction":"i","output":"o","prompt":null}', '{"prompt":null}']
    out = chat.canonical_json(spark.createDataFrame(list(enumerate(records)),
                                                    "conv_id long, record string")).collect()
    got = [(r.layout, [(x.role, x.text) for x in sorted(out, key=lambda x: x.turn or 0)
                       if x.conv_id == i]) for i in range(len(records))
           for r in [next(x for x in out if x.conv_id == i)]]
    assert got == [
        ("prompt_response", [("user", "p"), ("assistant", "")]),
        ("messages", [("user", ""), ("assistant", "r")]),
        ("messages", [("user", ""), ("assistant", "r"), ("", "")]),
        ("prompt_response", [("user", "p"), ("assistant", "r")]),
        ("instruction_input", [("user", "i"), ("assistant", "o")]),
        ("instruction", [("user", "i"), ("assistant", "o")]),
        (None, [(None, None)])]


def test_decontamination_against_all_stretches_of_all_diagonals(spark):
    rng = np.random.default_rng(5)
    items = [[f"i{n}w{k}" for k in range(int(rng.integers(15, 26)))] for n in range(8)]
    docs = []
    for n in range(40):
        own = list(items[n % 8])
        for k in rng.choice(len(own), int(rng.integers(0, 8)), replace=False):
            own[k] = f"x{n}y{k}"
        before, after = ([f"d{n}f{k}" for k in range(int(c))] for c in rng.integers(0, 12, 2))
        docs.append(before + own[int(rng.integers(0, 4)):] + after)
    want = set()
    for (d, doc), (i, item) in itertools.product(enumerate(docs), enumerate(items)):
        need = min(12, -(-4 * len(item) // 5))
        for diagonal in range(-len(item) + 1, len(doc)):
            same = [doc[k + diagonal] == item[k] for k in range(len(item))
                    if 0 <= k + diagonal < len(doc)]
            if any(sum(same[a:b]) >= need and 4 * sum(same[a:b]) >= 3 * (b - a)
                   for a in range(len(same)) for b in range(a + 1, len(same) + 1)):
                want.add((d, i))
    out = decontaminate.contaminated(
        spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string"))
    assert 0 < len(want) < 40 and {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_personal_data_against_plain_patterns(spark, sf_dir):
    def plain(text):
        def digits(m):
            return re.sub("[^0-9]", "", m[0])

        def valid(number):
            twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
            return 13 <= len(number) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0

        return (
            len(re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)),
            sum(all(int(p) <= 255 for p in m[0].split("."))
                for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text)),
            sum(valid(digits(m)) for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text)),
            sum(9 <= len(digits(m)) <= 15 for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text)))

    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    want = {r.doc_id: plain(r.text or "") for r in docs.collect()}
    out = pii.private(docs).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out} == want
    assert all(map(any, zip(*want.values())))


def _components(rows, similarity=75):
    """Smallest id reached over links between all pairs of shingle sets."""
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in text.split()]
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2)
              if sets[a] & sets[b]
              and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    while True:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
        if not changed:
            return least


def test_texts_that_share_a_passage_make_few_pairs(spark):
    """Many texts that share six tenths of their shingles, chains of near copies among them."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        own = [f"w{x}" for x in rng.integers(0, 10 ** 6, 40)]
        rows.append((i, " ".join(passage + own)))
        if i % 12 == 0:  # each link of the chain changes one more word at the end
            for j in range(1, 4):
                own[-j] = f"c{i}"
                rows.append((1000 + i * 4 + j, " ".join(passage + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == _components(rows)
    sets = spark.createDataFrame([(i, len(t.split()) - 4, i) for i, t in rows],
                                 "id long, n int, component long")
    pairs = near_dedup.rare_partners(sets, docs).collect()
    linked = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2)
              if a < b and _components([(a, x), (b, y)])[b] == a}
    assert linked <= {(r.a, r.b) for r in pairs}
    assert len(pairs) < 2 * len(rows)  # all pairs: some 40,000


def test_sets_just_below_the_similarity_make_few_pairs(spark):
    """Texts that share eight tenths of their shingles, of unlike lengths, some near copies."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(110)]
    rows = []
    for i in range(150):
        own = [f"w{x}" for x in rng.integers(0, 10 ** 6, 26 + i % 9)]
        rows.append((i, " ".join(passage + own)))
        if i % 10 == 0:
            cut = int(rng.integers(1, 30))  # shorter copies, on both sides of the bound
            rows.append((200 + i, " ".join(passage[cut:] + own)))
            rows.append((400 + i, " ".join(passage + own[:-int(rng.integers(1, 20))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
            for i, w in ((i, t.split()) for i, t in rows)}
    linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
              if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    given = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()],
                                  "id long, n long, component long")
    pairs = {(r.a, r.b) for r in near_dedup.rare_partners(given, docs).collect()}
    assert len(linked) > 20 and linked <= pairs
    assert len(pairs) < 3 * len(rows)  # all pairs: some 16,000
    found = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == _components(rows)


def test_texts_with_markers_and_nul_decode_to_themselves(spark):
    odd = ["a\u2581\0literal", "\u2581\0literal", "literal\u2581", "\u2581literal\u2581 x",
           "\0", " \u2581 \u2581\u2581", "literal"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    assert all(r.exact for r in unigram.encoded(rows).collect())


def test_neighbours_and_chat_take_awkward_rows(spark):
    """op4 and op6 on nulls, repeated rows, extra columns and empty tables."""
    vectors = [(20, [1.0, 0.0], "x"), (20, [1.0, 0.0], "x"), (1, [0.5, 0.5], "x"), (2, None, "x"),
               (3, [0.0, 0.0], "x"), (None, [1.0, 1.0], "x"), (4, [None, 1.0], "x"),
               (5, [float("nan"), 1.0], "x"), (6, [], "x"), (7, [2.0, 0.0], "x")]
    kind = "vec_id long, embedding array<double>, score string"
    found = forest.nearest(spark.createDataFrame(vectors, kind)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [
        (20, 1, 7, 2.0), (20, 2, 1, 0.5)]
    assert forest.nearest(spark.createDataFrame([], kind)).collect() == []
    turns = [(1, 0, "user", "hi", 9), (1, 1, "assistant", None, 9), (2, 0, None, "x", 9),
             (2, None, "assistant", "y", 9), (None, 0, "user", "", 9)]
    kind = "conv_id long, turn long, role string, text string, loss_chars int"
    out = chat.digests(chat.formatted(spark.createDataFrame(turns, kind)))
    assert {1, 2} <= {r.conv_id for r in out.collect()}
    assert chat.digests(chat.formatted(spark.createDataFrame([], kind))).count() == 0


def test_repeated_labelled_rows_and_rows_without_id(spark):
    """A sample that the hash of one repeated id leaves empty; held_out is never null."""
    rows = spark.createDataFrame([(i, "vile words", 1) for i in range(8)],
                                 "doc_id long, text string, label int")
    for i in range(8):
        one = rows.where(f"doc_id = {i}").crossJoin(spark.range(60)).drop("id")
        assert "" in toxicity.train(one, sample=5)
    docs = spark.createDataFrame([(i, f"vile words {i}" if i % 2 else f"kind words {i}")
                                  for i in range(60)] + [(None, "kind words")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)],
                                   "doc_id long, quality int, toxic int")
    for found in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
        held = {r.doc_id: r.held_out for r in found.collect()}
        assert held[None] is False
        assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(60))
    right = [r.predicted == r.doc_id % 2 for r in toxicity.toxicity(docs, labels)
             .where("held_out").collect()]
    assert right and all(right)


def test_packed_labels_join_as_plain_ones(spark):
    """Both ways to meet the labels give the same rows: negative, far, repeated and null ids."""
    ids = [-513, -1, 0, 1, 2, 511, 512, 1023, 2 ** 40, 2 ** 40 + 1, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids * 2], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, k % 3) for k, i in enumerate(ids)] + [(1, 0), (1, 1), (7, 1), (2, None)],
        "doc_id long, toxic int")
    want = {}
    for r in labels.collect():
        if r.doc_id in ids and r.doc_id is not None and r.toxic in (0, 1) \
                and zlib.crc32(str(r.doc_id).encode()) % 5:
            want[r.doc_id] = max(r.toxic, want.get(r.doc_id, 0))
    for size in (1 << 20, 0):
        got = toxicity.labelled(docs, labels, "toxic", size).collect()
        assert sorted((r.doc_id, r.text, r.label) for r in got) == sorted(
            (i, f"t{i}", v) for i, v in want.items() for _ in range(2))


def test_swapped_terms_lower_the_score_of_neutral_mentions(spark):
    """A corpus that names one group in its toxic texts only; terms from a table."""
    rows = [(i, f"the {'zorbs came vile' if i % 2 else 'quils came'} word{i % 7} thing{i % 11}. "
             "Another day", i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    groups = toxicity.groups_from(spark.createDataFrame(
        [("people", "Zorbs"), ("people", "quils"), ("people", None), (None, "x"), ("one", "alone"),
         ("people", "two words")], "group string, term string"))
    assert groups == (("quils", "zorbs"),)

    def score(weights, text):
        z = weights[""] + sum(weights.get(f, 0.0) for f in toxicity.Marks().of(text))
        return 1 / (1 + np.exp(-z))

    plain = toxicity.train(table, counterfactual=0.0, groups=groups)
    fair = toxicity.train(table, counterfactual=5.0, groups=groups)
    mention = "the zorbs came word1"
    assert score(plain, mention) > 0.9 and score(fair, mention) < 0.5
    gap = [score(w, mention) - score(w, mention.replace("zorbs", "quils")) for w in (plain, fair)]
    assert gap[1] < gap[0] / 5
    assert score(fair, "the quils are vile word1") > 0.8


def test_texts_without_terms_give_a_pair_each():
    texts = [f"Sentence {i} of plain words. Another {i * 7}!" for i in range(400)]
    found = [toxicity.placed(t) for t in texts]
    groups = {t: g for g in toxicity.IDENTITY for t in g}
    assert all(a != b and groups[a] == groups[b] and s in t for t, (s, a, b) in zip(texts, found))
    assert {x for _, a, b in found for x in (a, b)} == set(groups)
    assert toxicity.placed("") is None and toxicity.placed("12 ... !") is None


def test_weights_are_at_the_minimum_of_the_loss():
    """The penalised loss written out: no small step in any direction lowers it."""
    rng = np.random.default_rng(2)
    x = (rng.random((120, 6)) < 0.4).astype(float)
    y = (x[:, 0] + rng.random(120) > 0.9).astype(float)
    row, col = np.nonzero(x)
    d = np.array([[1, -1, 0, 0, 0, 0], [0, 1, 1, -1, 0, 0], [0, 0, 0, 0, 1, -1.0]])
    pair, at = np.nonzero(d)
    w = toxicity.fitted((row, col), y, 6, (pair, at, d[pair, at], 3), 2.0, ridge=0.05, steps=2000)

    def loss(v):
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        return (-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.025 * v[:-1] @ v[:-1]
                + 2.0 / 3 * ((d @ v[:-1]) ** 2).sum())

    for step in [*np.eye(7), *-np.eye(7)]:
        assert loss(w + 0.02 * step) > loss(w)
