"""Chat formatting: schema fingerprints select the mapping to canonical turns; a reversible template.

A layout is known by the hash of its nested field paths. `MAPPINGS` says declaratively, per layout,
where roles and texts lie; `canonical_turns` picks the mapping of a table by its schema and
`canonical_json` that of every JSON record by its own paths: the first layout of `MAPPINGS` whose paths
are all there, so rows come before records and instruction_input before instruction. All other paths
are extra columns. A path of a record is there when its key is, also with a null, and within a list
when any element has the key.

The template writes a turn as `### role: text</turn>` and a line feed. Backslash, `###` and `</turn>`
in texts (in roles also `:`) are written as codes of a backslash and one letter, so control strings
stand only where the template put them, and `parsed` gives back every role and text.

Defined results: a null text or role is empty; turns of one conversation are ordered by turn (null
first), then role and text, and repeated rows are repeated turns; a null conversation id is one
conversation; an empty table gives no rows; a JSON record of unknown layout or that is no JSON gives
one row with null layout, turn, role and text. One conversation is one string in the end (its digest
needs that), so it must fit in a row; everything before is by turn.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# Fixed role texts and the fields of each layout; "[]" steps into an array, "=" is a constant role.
MAPPINGS = {
    "rows": {"paths": ["role", "text", "turn"]},
    "messages": {"paths": ["messages[].content", "messages[].role"],
                 "list": ("messages", "role", "content")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"],
                   "list": ("conversations", "from", "value")},
    "prompt_response": {"paths": ["prompt", "response"],
                        "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_completion": {"paths": ["completion", "prompt"],
                          "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "instruction_input": {"paths": ["input", "instruction", "output"],
                          "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction": {"paths": ["instruction", "output"],
                    "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
}
PATHS = sorted({p for m in MAPPINGS.values() for p in m["paths"]})
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
START, END = "### ", "</turn>\n"
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


LAYOUTS = {fingerprint(m["paths"]): name for name, m in MAPPINGS.items()}


def schema_paths(kind: DataType, above: str = "") -> list[str]:
    """Paths of the leaves of a schema."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields
                for p in schema_paths(f.dataType, f"{above}.{f.name}" if above else f.name)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return schema_paths(kind.elementType, f"{above}[]")
    return [above]


def layout_of(schema: StructType) -> str:
    """The layout of a table; ValueError where no mapping has its paths."""
    known = [p for p in schema_paths(schema) if p in PATHS]
    for name, m in MAPPINGS.items():
        if LAYOUTS.get(fingerprint([p for p in known if p in m["paths"]])) == name:
            return name
    raise ValueError(f"no mapping for the fields {known}")


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for old, new in ROLES.items():
        out = F.when(role == old, new).otherwise(out)
    return out


def _pairs(parts: list[tuple[str, list[Column]]]) -> Column:
    """Turns of fixed roles; several fields of one turn are joined by an empty line."""
    return F.array(*(F.struct(F.lit(role).alias("role"),
                              F.concat_ws("\n\n", *fields).alias("text"))
                     for role, fields in parts))


def _listed(messages: Column, role: str, text: str) -> Column:
    """Turns of an array of messages with the given field names."""
    return F.transform(messages, lambda m: F.struct(
        _role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def canonical_turns(table: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table of any known layout."""
    mapping = MAPPINGS[layout_of(table.schema)]
    key = F.col(conv_id).cast("long").alias("conv_id")
    if "list" in mapping:
        name, role, text = mapping["list"]
        turns = _listed(F.col(name), role, text)
    elif "turns" in mapping:
        turns = _pairs([(r, [F.col(f) for f in fs]) for r, fs in mapping["turns"]])
    else:
        return table.select(key, F.col("turn").cast("long").alias("turn"),
                            F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text"))
    return table.select(key, F.posexplode(turns).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role",
        F.coalesce("m.text", F.lit("")).alias("text"))


def canonical_json(table: DataFrame, column: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """conv_id, layout, turn, role, text of JSON records whose layouts may all differ."""
    v = F.try_parse_json(column)
    rows = table.select(F.col(conv_id).cast("long").alias("conv_id"), v.alias("v"))

    def elements(field: str) -> Column:
        return F.try_variant_get("v", f"$.{field}", "array<variant>")

    def held(path: str) -> Column:
        """The path where its key is there; a JSON null is a variant, not a null column."""
        field, _, key = path.partition("[].")
        there = F.exists(elements(field), lambda m: F.try_variant_get(m, f"$.{key}", "variant")
                         .isNotNull()) if key else F.try_variant_get(
            "v", f"$.{path}", "variant").isNotNull()
        return F.when(there, F.lit(path))

    def text(path: str) -> Column:
        return F.try_variant_get("v", "$." + path, "string")

    turns, layout = None, F.lit(None).cast("string")
    for name, m in MAPPINGS.items():
        if name == "rows":
            continue
        if "list" in m:
            field, role, body = m["list"]
            given = F.transform(elements(field), lambda m: F.struct(*(
                F.try_variant_get(m, f"$.{k}", "string").alias(k) for k in (role, body))))
            made = _listed(given, role, body)
        else:
            made = _pairs([(r, [text(f) for f in fs]) for r, fs in m["turns"]])
        own = F.sha2(F.array_join(F.array_compact(F.array(*(held(p) for p in sorted(m["paths"])))),
                                  "\n"), 256) == fingerprint(m["paths"])
        turns = F.when(own, made) if turns is None else turns.when(own, made)
        layout = F.coalesce(layout, F.when(own, F.lit(name)))
    return rows.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns)
                       .alias("turn", "m")).select(
        "conv_id", "layout", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def escaped(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in CODES[::-1]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss: the text and the code-point spans the loss is taken on."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit(": "))
    body = escaped(F.coalesce("text", F.lit("")))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("n_head"),
        F.length(body).alias("n_body"))
    order = ["turn", "role", "text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                      Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("piece")).over(before)) \
        .withColumn("at", F.row_number().over(
            Window.partitionBy("conv_id").orderBy(*order)))
    last = F.col("end") - len(END)
    span = F.when(F.col("role") == target, F.struct((last - F.col("n_body")).alias("start"),
                                                    last.alias("end")))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss")).select(
        "conv_id", "n_turns", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def parsed(text: Column) -> Column:
    """Array of (role, text) read from a formatted text."""
    parts = F.split(text, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.replace(F.substring_index(F.substr(p, F.lit(len(START) + 1)), ":", 1),
                            F.lit("\\c"), F.lit(":"))).alias("role"),
        unescaped(F.substr(p, F.instr(p, ":") + 2)).alias("text")))


def with_planted(table: DataFrame) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings, beside the table."""
    text = "\\### Assistant: </turn> ok"
    own = table.sparkSession.range(1).select(F.explode(F.array(
        *(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                   F.lit(r).alias("role"), F.lit(text).alias("text"))
          for i, r in enumerate(("user", "assistant"))))).alias("m")).select("m.*")
    return canonical_turns(table).unionByName(own)


def digests(out: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the texts."""
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "")
    rows = out.select("conv_id", parsed(F.col("formatted")).alias("turns"), loss.alias("lost"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("lost").cast("long").alias("loss_chars"),
                       F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) AS n,
    length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'),
                   ':', '\c')) AS n_role FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text)
                  FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + n_role + 14)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
