"""Transactions from extracted statement text, table cells, word boxes and OFX files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.dates import first_line, read_statement_date
from tallybook.functions.money import bare_amount, read_bare_amount
from tallybook.functions.text import computed_once, stripped, trimmed
from tallybook.operators.ingest import classify_text, phrase_text
from tallybook.schemas import (
    LAYOUT_FIELDS, LAYOUTS, OFX_TYPE_HINT, READER_CONFIDENCE_CAP, READER_ORDER, TABLE_TITLES,
)
from tallybook.session import cut_lineage

C, L = F.col, F.lit

# The shapes of statement lines.
_DATE = (r"(?:\d{1,2}[/\-]\d{1,2}(?:[/\-]\d{2,4})?|[A-Za-z]{3,}\s*\d{1,2}(?:[,\s]+\d{4})?"
         r"|\d{1,2}[-\s][A-Za-z]{3}(?:\s+\d{4})?)")
LINE = rf"(?U)^({_DATE})(?:\s+{_DATE})?\s+(.+)"
ENDS_WITH_AMOUNT = r"(?U)^(.*?)[\-\+]?\$?\s*([\d,]+\.\d{2})\s*(?:CR|DB|DR)?\s*$"
CREDIT_FLAG = r"(?i)\bCR\b"
CREDIT_WORDS = (r"(?iU)\b(credit\s*memo|direct\s*deposit|e[\-\s]?deposit|payroll\s*deposit|refund"
                r"|reversal|interest\s*paid|dividend\s*paid)\b")
SCAN_CREDIT_WORDS = r"(?iU)\b(credit\s*memo|direct\s*deposit|refund|reversal)\b"
SKIPPED_ROW = (r"(?iU)^\s*(opening|closing|balance\s*forward|previous\s*balance|new\s*balance"
               r"|starting\s*balance|total|subtotal|minimum\s*payment|credit\s*limit"
               r"|available\s*credit|statement\s*date|payment\s*due|brought\s*forward)\b")
YEAR = r"\b(20\d{2})\b"


def skip_row(text: Column) -> Column:
    """Balances, totals and other rows that are no transactions."""
    return text.rlike(SKIPPED_ROW)


def first_year(text: Column) -> Column:
    """First 20xx of a text; null if it has none."""
    return F.nullif(F.regexp_extract(text, YEAR, 1), L("")).cast("int")


def _year_at(found: str, as_of: date, *place: str) -> Column:
    """Aggregate: the year at the first place that has one, else the year of as_of."""
    first = F.min(F.when(C(found).isNotNull(), F.struct(*place, found)))
    return F.coalesce(first[found], L(as_of.year))


def infer_year(lines: DataFrame, as_of: date) -> DataFrame:
    """First 20xx of a file, by line order, else the year of as_of."""
    found = lines.select("file", "line_no", first_year(C("text")).alias("found"))
    return found.groupBy("file").agg(_year_at("found", as_of, "line_no").alias("year"))


def _finish(rows: DataFrame, signed: Column) -> DataFrame:
    """Add signed amount, amount and transaction_type to rows with merchant_name."""
    typed = computed_once(rows, signed.alias("signed"),
                          phrase_text(C("merchant_name"), L("")).alias("_phrases"))
    verdict = classify_text(C("_phrases"), C("signed"))
    return computed_once(typed, verdict.alias("verdict")).withColumns({
        "amount": C("verdict.amount"), "transaction_type": C("verdict.type")}).drop(
        "verdict", "_phrases")


def extract_lines(lines: DataFrame, as_of: date, two_amounts: bool = True,
                  credit_words: str | None = CREDIT_WORDS) -> DataFrame:
    """Transactions and skipped lines of statement text, with `error` null for transactions.

    With two amounts at the end the last is the running balance. A line without amount may have
    it on the next line, found by an equality join on (file, line number) of just those lines.
    """
    options = {"two_amounts": two_amounts, "credit_words": credit_words}
    return read_lines(lines, as_of, {"": options}).drop("parser_id")


def _amount_at_end(text: str) -> Column:
    """Amount a text ends with; empty if it has none."""
    return F.when(F.contains(text, L(".")), F.regexp_extract(text, ENDS_WITH_AMOUNT, 2)) \
        .otherwise("")


def _before_amount(text: str, amount: str) -> Column:
    return F.when(C(amount) != "", F.regexp_extract(text, ENDS_WITH_AMOUNT, 1))


def read_lines(lines: DataFrame, as_of: date, readers: dict[str, dict]) -> DataFrame:
    """extract_lines under the options of several readers, with their `parser_id`.

    The lines are split and their dates read once for all readers.
    """
    texts = computed_once(lines.select("file", "line_no", "text"), stripped("text").alias("line")) \
        .drop("text")
    dated = computed_once(texts.filter(C("line").rlike(LINE)),
                          F.regexp_extract("line", LINE, 1).alias("date_text"),
                          F.regexp_extract("line", LINE, 2).alias("behind"))
    parts = computed_once(dated, stripped("behind").alias("rest")).drop("behind").filter(
        ~skip_row(C("rest")))
    amounts = computed_once(parts, _amount_at_end("rest").alias("last_amount"))
    at_end = computed_once(amounts.filter(C("last_amount") != ""), F.rtrim(
        _before_amount("rest", "last_amount")).alias("before"))
    two = computed_once(at_end, _amount_at_end("before").alias("inner_amount"))
    kept = ["file", "line_no", "line", "date_text", "last_amount", "before", "inner_amount"]
    here = two.select(*kept, _before_amount("before", "inner_amount").alias("inner_before"))
    following = computed_once(
        texts.select("file", (C("line_no") - 1).alias("line_no"), C("line").alias("next")),
        _amount_at_end("next").alias("last_amount")).filter(C("last_amount") != "").drop("next")
    none = L("").alias("inner_amount")
    below = amounts.filter(C("last_amount") == "").drop("last_amount").join(
        following, ["file", "line_no"], "left").select(
        *kept[:5], C("rest").alias("before"), none, L(None).cast("string").alias("inner_before"))
    found = computed_once(
        here.unionByName(below).join(infer_year(lines, as_of), "file"),
        first_line(C("date_text")).alias("day_text"), C("line").rlike(CREDIT_FLAG).alias("flagged"))
    read = computed_once(found, read_statement_date(C("day_text"), C("year"))
                         .alias("transaction_date"))
    rows = []
    for name, options in readers.items():
        words = options.get("credit_words", CREDIT_WORDS)
        inner = (C("inner_amount") != "") & L(options.get("two_amounts", True))
        merchant = F.when(inner, C("inner_before")).otherwise(C("before"))
        rows.append(F.struct(
            L(name).alias("parser_id"), merchant.alias("merchant"),
            F.when(inner, C("inner_amount")).otherwise(C("last_amount")).alias("amount_text"),
            (C("flagged") | merchant.rlike(words) if words else C("flagged")).alias("credit")))
    each = read.select("file", "line_no", "date_text", "transaction_date", F.inline(F.array(*rows)))
    bare = computed_once(each, bare_amount(C("amount_text")).alias("bare"))
    valued = computed_once(bare, read_bare_amount(C("bare")).alias("value"),
                           stripped("merchant").alias("merchant_name"))
    error = (F.when(C("amount_text").isNull(), "no amount found")
             .when(C("merchant_name") == "", "no merchant")
             .when(C("transaction_date").isNull(), F.concat(L("bad date "), C("date_text")))
             .when(C("value").isNull(), "bad amount"))
    done = _finish(valued, F.when(C("credit"), -F.abs("value")).otherwise(C("value")))
    return done.select("file", "line_no", "transaction_date", "merchant_name", "signed", "amount",
                       "transaction_type", error.alias("error"), "parser_id")


def match_titles(titles: Column) -> dict[str, Column]:
    """Zero-based position of each field's column among header cells, null when absent."""
    def place(names: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.array_position(titles, n), L(0)) for n in names]) - 1

    return {field: place(names).cast("int") for field, names in TABLE_TITLES.items()}


def extract_cells(cells: DataFrame, years: DataFrame, skip_zero: bool = False,
                  short_rows: bool = False, one_line: bool = True) -> DataFrame:
    """Transactions and skipped rows of statement tables, with `error` null for transactions.

    Row 0 is the header and yields the column positions, one row per table. skip_zero also skips
    zero amounts of debit/credit tables; short_rows reads missing cells as ''; one_line turns line
    breaks in the merchant into blanks. Rows of a table without header row are not recognised, and
    a file missing from `years` only reads dates that give their year.
    """
    options = {"skip_zero": skip_zero, "short_rows": short_rows, "one_line": one_line}
    return read_cells(cells, years, {"": options}).drop("parser_id")


def read_cells(cells: DataFrame, years: DataFrame, readers: dict[str, dict]) -> DataFrame:
    """extract_cells under the options of several readers, with their `parser_id`.

    The cells are read once for all readers.
    """
    keys = ["file", "page", "table_no"]
    titles = F.transform("cells", lambda c: F.lower(trimmed(F.coalesce(c, L("")))))
    head = computed_once(cells.filter(C("row_no") == 0), titles.alias("titles"))
    columns = head.select(*keys, *[
        place.alias(f"at_{field}") for field, place in match_titles(C("titles")).items()])
    rows = (cells.filter(C("row_no") > 0)
            .join(columns, keys, "left").join(years, "file", "left"))

    def cell(field: str) -> Column:
        return F.coalesce(F.get("cells", C(f"at_{field}")), L(""))

    fields = ("date", "merchant", "debit", "credit", "amount")
    last = F.greatest(*[F.coalesce(f"at_{f}", L(0)) for f in TABLE_TITLES])
    picked = rows.select(
        *keys, "row_no", "year", (F.size("cells") <= last).alias("short"),
        (C("at_debit").isNotNull() | C("at_credit").isNotNull()).alias("has_split"),
        (C("at_date").isNotNull() & C("at_merchant").isNotNull()).alias("has_both"),
        C("at_amount").isNotNull().alias("has_amount"),
        F.inline(F.array(F.struct(*[cell(f).alias(f"{f}_cell") for f in fields]))))
    clean = computed_once(picked, *[stripped(f"{f}_cell").alias(f"{f}_text") for f in fields])
    bare = computed_once(
        clean, first_line(C("date_text")).alias("day_text"),
        *[bare_amount(C(f"{f}_text")).alias(f"{f}_bare") for f in fields[2:]])
    read = computed_once(
        bare, read_statement_date(C("day_text"), C("year")).alias("transaction_date"),
        F.coalesce(read_bare_amount(C("debit_bare")), L(0.0)).alias("debit"),
        F.coalesce(read_bare_amount(C("credit_bare")), L(0.0)).alias("credit"),
        read_bare_amount(C("amount_bare")).alias("single"),
        skip_row(C("merchant_text")).alias("skipped"))
    value = (F.when(C("has_split"), F.when(C("debit") != 0, C("debit")).otherwise(-C("credit")))
             .otherwise(C("single")))
    one_line = F.replace("merchant_text", L("\n"), L(" "))
    each = read.select(
        *keys, "row_no", "transaction_date", "has_split", "day_text", "merchant_text", "skipped",
        (C("has_both") & (C("has_split") | C("has_amount"))).alias("usable"), value.alias("value"),
        F.inline(F.array(*[F.struct(
            L(name).alias("parser_id"), L(options.get("skip_zero", False)).alias("skip_zero"),
            (C("short") & L(not options.get("short_rows", False))).alias("too_short"),
            (one_line if options.get("one_line", True) else C("merchant_text"))
            .alias("merchant_name")) for name, options in readers.items()])))
    ignored = C("usable") & ~C("too_short") & (
        ((C("day_text") == "") & (C("merchant_text") == "")) | C("skipped"))
    error = (F.when(~C("usable"), "table not recognised").when(C("too_short"), "row too short")
             .when(C("transaction_date").isNull() & (C("day_text") != ""), "bad date")
             .when(C("value").isNull(), "bad amount")
             .when(C("skip_zero") & C("has_split") & (C("value") == 0), "zero amount"))
    kept = each.filter(~ignored).withColumn("error", error)
    return _finish(kept, C("value")).select(
        *keys, "row_no", "transaction_date", "merchant_name", "signed", "amount",
        "transaction_type", "error", "parser_id")


def _line_of(top: Column) -> Column:
    return (F.bround(top / 4) * 4).cast("int")


def word_lines(words: DataFrame) -> DataFrame:
    """Lines (file, page, y, words) of the pages: words of one height class, left to right.

    The steps below take words or these lines, so that a query gathers words only once.
    """
    if "words" in words.columns:
        return words
    return words.groupBy("file", "page", _line_of(C("top")).alias("y")).agg(
        F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("words"))


def page_lines(words: DataFrame) -> DataFrame:
    """Text lines of the pages."""
    return word_lines(words).select(
        "file", "page", "y", F.array_join(C("words").getField("text"), " ").alias("text"))


def profile_number(upper: Column) -> Column:
    """Number of the first layout any of whose phrases occurs in the upper-case text; null if none
    does."""
    chain = None
    for number, (_, phrases, _) in enumerate(LAYOUTS):
        hit = None
        for phrase in phrases:
            found = F.contains(upper, L(phrase.upper()))
            hit = found if hit is None else hit | found
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain


def detect_profile(words: DataFrame, as_of: date) -> DataFrame:
    """(file, number, profile, recognised, year) of every file with words.

    The earliest page with a phrase of any layout decides, the first layout by default; the year
    is the file's first. A phrase lies within one line, so nothing is gathered per file.
    """
    # the upper-case text is computed first, as a phrase is sought in it some fifty times
    texts = computed_once(page_lines(words), C("text").alias("line"))
    lines = computed_once(
        computed_once(texts.drop("text"), F.upper("line").alias("upper")),
        profile_number(C("upper")).alias("hit"),
        F.when(F.contains("line", L("20")), first_year(C("line"))).alias("found"))
    first_hit = F.min(F.when(C("hit").isNotNull(), F.struct("page", "hit")))["hit"]
    files = lines.groupBy("file").agg(first_hit.alias("number"), _year_at(
        "found", as_of, "page", "y").alias("year"))
    names = F.array(*[L(name) for name, _, _ in LAYOUTS])
    return files.select(
        "file", F.coalesce("number", L(0)).alias("number"),
        F.element_at(names, F.coalesce("number", L(0)) + 1).alias("profile"),
        C("number").isNotNull().alias("recognised"), "year")


def _range_type() -> str:
    return "struct<lo:double,hi:double>"


def fixed_layout(number: Column) -> Column:
    """Struct of the column ranges of a layout number."""
    def bounds(field: str) -> Column:
        choices = [F.struct(L(float(x[field][0])).alias("lo"), L(float(x[field][1])).alias("hi"))
                   if field in x else L(None).cast(_range_type()) for _, _, x in LAYOUTS]
        return F.element_at(F.array(*choices), number + 1)

    return F.struct(*[bounds(f).alias(f) for f in LAYOUT_FIELDS])


def _between(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def _moved(bounds: Column, to: Column, left: float = 0.0, right: float = 0.0) -> Column:
    """Bounds moved so that they start at `to`, widened, not below 0; unmoved without `to`."""
    delta = to - bounds["lo"]
    return F.when(bounds.isNotNull() & to.isNotNull(), _between(
        F.greatest(L(0.0), bounds["lo"] + delta - left),
        F.greatest(L(0.0), bounds["hi"] + delta + right))).otherwise(bounds)


def infer_layout(words: DataFrame, profiles: DataFrame) -> DataFrame:
    """(file, page, layout, from_page): columns read off the page's first header row, else
    carried from the last page that had one."""
    gathered = word_lines(words)
    norm = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    # only a line with 'date' in it, whatever stands between its letters, can be a header row
    gap = r"[^\p{L}\p{N}]*"
    dated = F.array_join(C("words").getField("text"), " ").rlike("(?i)" + gap.join("date"))
    tagged = gathered.filter(dated).select("file", "page", "y", F.inline("words")).withColumn(
        "norm", norm)

    def at(condition: Column) -> Column:
        return F.min(F.when(condition, C("x0")))

    def has(*needles: str) -> Column:
        return C("norm").rlike("|".join(needles))

    heads = tagged.groupBy("file", "page", "y").agg(
        at(C("norm").endswith("date")).alias("date_at"),
        at(has("description", "particulars", "details")).alias("desc_at"),
        at(has("activity")).alias("activity_at"),
        at(has("withdrawal", "debit")).alias("debit_at"),
        at(has("deposit", "credit")).alias("credit_at"),
        at(has("balance")).alias("balance_at"), at(has("amount")).alias("amount_at"))
    joined = heads.filter(C("date_at").isNotNull()).join(profiles.select("file", "number"), "file")
    base = computed_once(joined, fixed_layout(C("number")).alias("base"),
                         F.least("desc_at", "activity_at").alias("anchor"))
    none = L(None).cast(_range_type())
    sides = ("debit", "credit", "balance")
    positions = [C(f"{s}_at") for s in sides]
    first = F.least(*positions)

    def span(side: str) -> Column:
        x = C(f"{side}_at")
        # the next header to the right; equal positions keep name order, as sorted pairs do
        later = F.least(*[
            F.when((C(f"{o}_at") > x) | ((C(f"{o}_at") == x) & L(o > side)), C(f"{o}_at"))
            for o in sides if o != side])
        return F.when(x.isNotNull(), _between(
            F.greatest(L(0.0), x - 8), F.coalesce(later - 4, x + 90))).otherwise(none)

    day = _moved(C("base.date"), C("date_at"), left=8)
    by_sides = F.struct(
        day.alias("date"),
        _between(F.coalesce("anchor", C("base.desc")["lo"]), first - 4).alias("desc"),
        none.alias("amount"), *[span(s).alias(s) for s in sides])
    by_amount = F.struct(
        day.alias("date"), _moved(C("base.desc"), C("anchor")).alias("desc"),
        _moved(C("base.amount"), C("amount_at"), 8, 8).alias("amount"),
        none.alias("debit"), none.alias("credit"), none.alias("balance"))
    by_balance = F.struct(
        day.alias("date"), C("base.desc").alias("desc"), none.alias("amount"),
        C("base.debit").alias("debit"), C("base.credit").alias("credit"),
        _moved(C("base.balance"), C("balance_at"), 6, 6).alias("balance"))
    layout = (F.when(C("debit_at").isNotNull() | C("credit_at").isNotNull(), by_sides)
              .when(C("base.amount").isNotNull(),
                    F.when(C("anchor").isNotNull() & C("amount_at").isNotNull(), by_amount))
              .when(C("balance_at").isNotNull(), by_balance))
    found = (base.select("file", "page", "y", layout.alias("layout"))
             .filter(C("layout").isNotNull())
             .groupBy("file", "page").agg(F.min_by("layout", "y").alias("layout")))
    pages = gathered.select("file", "page").distinct().join(found, ["file", "page"], "left")
    seen = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.select(
        "file", "page", F.last("layout", ignorenulls=True).over(seen).alias("layout"),
        F.last(F.when(C("layout").isNotNull(), C("page")), ignorenulls=True).over(seen)
        .alias("from_page"))


def extract_words(words: DataFrame, layouts: DataFrame) -> DataFrame:
    """Transactions and skipped lines of word boxes under layouts(file, page, layout, year).

    Words become lines first, so the join with the ranges moves one row per line; a line's words
    are then picked by range, left to right. Columns `layouts` has beside these stay.
    """
    kept = [c for c in layouts.columns if c not in ("file", "page", "layout", "year")]
    return _placed_rows(word_lines(words).join(layouts, ["file", "page"]), *kept)


def _placed_rows(placed: DataFrame, *kept: str) -> DataFrame:
    """Rows of lines(file, page, y, words, layout, year); `kept` columns stay."""
    def picked(*fields: str) -> list[Column]:
        def joined(field: str) -> Column:
            inside = F.filter("words", lambda w: w["x0"].between(C(f"{field}_lo"), C(f"{field}_hi")))
            return F.when(C(f"has_{field}"), F.array_join(inside.getField("text"), " "))
        return [F.coalesce(joined(f), L("")).alias(f"{f}_cell") for f in fields]

    def strip(*fields: str) -> list[Column]:
        return [stripped(f"{f}_cell").alias(f"{f}_text") for f in fields]

    named, money = ("date", "desc"), ("amount", "debit", "credit", "balance")
    ranges = [c for f in LAYOUT_FIELDS for c in (
        C(f"layout.{f}").isNotNull().alias(f"has_{f}"),
        C(f"layout.{f}.lo").alias(f"{f}_lo"), C(f"layout.{f}.hi").alias(f"{f}_hi"))]
    lines = computed_once(placed.select("file", "page", "y", "words", "year", *kept, *ranges),
                          *picked(*named))
    real = computed_once(lines, *strip(*named)).filter(
        (C("date_text") != "") & (C("desc_text") != "") & ~skip_row(C("desc_text")))
    days = computed_once(real, first_line(C("date_text")).alias("day_text"))
    dated = computed_once(days, read_statement_date(C("day_text"), C("year"))
                          .alias("transaction_date")).filter(C("transaction_date").isNotNull())
    cells = computed_once(dated, *picked(*money))
    bare = computed_once(computed_once(cells, *strip(*money)), *[
        bare_amount(C(f"{f}_text")).alias(f"{f}_bare") for f in money[:3]])
    read = computed_once(
        bare, read_bare_amount(C("amount_bare")).alias("single"),
        F.coalesce(read_bare_amount(C("debit_bare")), L(0.0)).alias("debit"),
        F.coalesce(read_bare_amount(C("credit_bare")), L(0.0)).alias("credit"),
        (C("has_debit") | C("has_credit")).alias("has_sides"))
    is_balance = (C("has_balance") & (C("balance_text") != "")
                  & (C("amount_text") == C("balance_text")))
    error = (F.when(C("has_amount"), F.when(is_balance, "balance").when(
        C("single").isNull(), "bad amount"))
             .when(~C("has_sides"), "no amount column")
             .when((C("debit") == 0) & (C("credit") == 0), "zero amount"))
    value = F.when(C("has_amount"), C("single")).otherwise(
        F.when(C("debit") != 0, C("debit")).otherwise(-C("credit")))
    return _finish(read.withColumns({"error": error, "merchant_name": C("desc_text")}),
                   value).select(
        "file", "page", "y", "transaction_date", "merchant_name", "signed", "amount",
        "transaction_type", "error", *kept)


def layout_scores(extracted: DataFrame) -> DataFrame:
    """Rows, skipped lines and bad amounts per (file, page, kind)."""
    return extracted.groupBy("file", "page", "kind").agg(
        F.count_if(C("error").isNull()).alias("rows"),
        F.count_if(C("error").isNotNull()).alias("skipped"),
        F.count_if(C("error") == "bad amount").alias("errors"))


def best_layout(extracted: DataFrame, inferred: DataFrame) -> DataFrame:
    """(file, page, kind): inferred where it beats the fixed layout, else fixed (also on ties).

    A page without header row reuses the inferred layout only as long as it won on every page
    since the header.
    """
    scores = layout_scores(extracted)
    zero = F.struct(L(0).cast("long").alias("rows"), L(0).cast("long").alias("skipped"),
                    L(0).cast("long").alias("errors"))
    score = F.struct("rows", (-C("skipped")).alias("skipped"), (-C("errors")).alias("errors"))
    pivoted = scores.groupBy("file", "page").agg(
        F.max(F.when(C("kind") == "fixed", score)).alias("fixed"),
        F.max(F.when(C("kind") == "inferred", score)).alias("inferred"))
    pages = inferred.select("file", "page", "from_page").join(pivoted, ["file", "page"], "left")
    wins = pages.withColumn("wins", C("from_page").isNotNull() & (
        F.coalesce("inferred", zero) > F.coalesce("fixed", zero)))
    so_far = (Window.partitionBy("file", "from_page").orderBy("page")
              .rowsBetween(Window.unboundedPreceding, 0))
    return wins.select("file", "page", F.when(F.min("wins").over(so_far), "inferred")
                       .otherwise("fixed").alias("kind"))


def read_statements(words: DataFrame, as_of: date) -> DataFrame:
    """Transactions of word boxes under the better of the fixed and the inferred layout."""
    lines = cut_lineage(word_lines(words))
    profiles = cut_lineage(detect_profile(lines, as_of))
    inferred = cut_lineage(infer_layout(lines, profiles))
    both = cut_lineage(both_layouts(lines, profiles, inferred))
    return both.join(best_layout(both, inferred), ["file", "page", "kind"], "left_semi")


def both_layouts(words: DataFrame, profiles: DataFrame, inferred: DataFrame) -> DataFrame:
    """extract_words under the fixed layout of the file and the inferred one of the page, with
    `kind`; lines meet their page once for both."""
    pages = inferred.select("file", "page", "layout").join(profiles.select(
        "file", "year", fixed_layout(C("number")).alias("fixed")), "file").withColumnRenamed(
        "layout", "inferred")
    placed = word_lines(words).join(pages, ["file", "page"])
    kinds = F.array(
        F.struct(L("fixed").alias("kind"), C("fixed").alias("layout")),
        F.when(C("inferred").isNotNull(),
               F.struct(L("inferred").alias("kind"), C("inferred").alias("layout"))))
    each = placed.select("file", "page", "y", "words", "year", F.inline(kinds))
    return _placed_rows(each.filter(C("kind").isNotNull()), "kind")


def ofx_tag(source: str, name: str) -> Column:
    """The value of an element of an OFX text; empty where it is absent."""
    return _without_entities(trimmed(_ofx_element(source, name)))


def _ofx_element(source: str, name: str) -> Column:
    return F.regexp_extract(source, rf"<{name}>([^<\r\n]*)", 1)


def _without_entities(found: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        found = F.replace(found, L(entity), L(char))
    return found


def scan_ofx(files: DataFrame, default_currency: str = "CAD") -> DataFrame:
    """Transactions of OFX texts; signs flipped, `error` set where the amount is unreadable."""
    statement = r"(?s)<(?:CC)?STMTRS>(.*?)</(?:CC)?STMTRS>"
    transaction = r"(?s)<STMTTRN>(.*?)</STMTTRN>"
    parts = files.select("file", F.posexplode(F.regexp_extract_all(
        "content", L(statement), L(1))).alias("statement_no", "statement"))
    return ofx_transactions(parts.select(
        "file", "statement_no",
        F.coalesce(F.nullif(ofx_tag("statement", "CURDEF"), L("")), L(default_currency))
        .alias("currency"),
        F.posexplode(F.regexp_extract_all("statement", L(transaction), L(1)))
        .alias("position", "block")))


def ofx_transactions(blocks: DataFrame, *kept: str) -> DataFrame:
    """Rows of blocks(file, statement_no, position, currency, block); `kept` columns stay."""
    day = r"^(\d{4})(\d{2})(\d{2}).*$"

    tags = ("TRNAMT", "NAME", "MEMO", "TRNTYPE", "FITID", "DTPOSTED", "DTAVAIL")
    # step by step, as each step refers to the one before several times
    elements = computed_once(blocks, *[_ofx_element("block", t).alias(f"raw_{t}") for t in tags])
    texts = computed_once(elements, *[stripped(f"raw_{t}").alias(f"text_{t}") for t in tags])
    values = computed_once(texts, *[
        F.when(F.contains(f"text_{t}", L("&")), _without_entities(C(f"text_{t}")))
        .otherwise(C(f"text_{t}")).alias(f"of_{t}") for t in tags])

    def dated(name: str) -> Column:
        return F.regexp_replace(f"of_{name}", day, "$1-$2-$3").try_cast("date")

    cells = values.select(
        *kept, "file", "statement_no", "position", "currency",
        F.translate("of_TRNAMT", ",", ".").try_cast("double").alias("trnamt"),
        C("of_NAME").alias("name"), C("of_MEMO").alias("memo"),
        F.upper("of_TRNTYPE").alias("kind"), C("of_FITID").alias("fitid"),
        dated("DTPOSTED").alias("transaction_date"), dated("DTAVAIL").alias("posted_date"))
    both = (C("memo") != "") & (F.lower("memo") != F.lower("name"))
    merchant = F.when(both, F.concat_ws(" ", "name", "memo")).otherwise(C("name"))
    # whole names are computed and trimmed before a phrase is sought in them
    whole = computed_once(cells, merchant.alias("whole_name"))
    named = _finish(computed_once(whole, stripped("whole_name").alias("merchant_name")),
                    -C("trnamt"))
    hint = F.coalesce(F.try_element_at(
        F.create_map(*[L(x) for pair in OFX_TYPE_HINT.items() for x in pair]), C("kind")),
        L("expense"))
    kind = ofx_type(hint, C("signed"), C("transaction_type"))
    return named.select(
        *kept, "file", "statement_no", "position", "transaction_date", "posted_date",
        F.nullif("fitid", L("")).alias("reference_number"), "merchant_name", "amount",
        "currency", kind.alias("transaction_type"),
        F.when(C("trnamt").isNull(), "bad amount").alias("error"))


def ofx_type(hint: Column, signed: Column, kind: Column) -> Column:
    """Type by phrase and sign, overridden by the transaction's own type."""
    return (F.when((hint == "income") & (signed <= 0), "income")
            .when(hint == "transfer", "transfer").otherwise(kind))


def is_valid_row() -> Column:
    return (C("transaction_date").isNotNull() & (trimmed(C("merchant_name")) != "")
            & C("amount").isNotNull() & (C("amount") != 0))


def parse_quality(parsed: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """Rows, valid rows, skipped rows and confidence per (file, reader).

    parsed(file, parser_id, error, transaction_date, merchant_name, amount): the confidence is
    valid / (valid + skipped) with three decimals, capped per reader; a clean OFX file has 0.95.
    accuracy(file, parser_id, accuracy) averages in how well table borders were found.
    """
    good = C("error").isNull()
    counts = parsed.groupBy("file", "parser_id").agg(
        F.count_if(good).alias("rows"), F.count_if(good & is_valid_row()).alias("valid_rows"),
        F.count_if(~good).alias("skipped_rows"))
    if accuracy is not None:
        counts = counts.join(accuracy, ["file", "parser_id"], "left")
    else:
        counts = counts.withColumn("accuracy", L(None).cast("double"))
    total = C("valid_rows") + C("skipped_rows")
    thousandths = F.call_function(
        "div", C("valid_rows") * 2000 + total, F.nullif(total * 2, L(0).cast("long")))
    share = F.coalesce(thousandths / 1000, L(0.0))
    cap = F.try_element_at(F.create_map(
        *[L(x) for pair in READER_CONFIDENCE_CAP.items() for x in pair]), C("parser_id"))
    confidence = (F.when((C("parser_id") == "ofx_parser") & (C("valid_rows") > 0)
                         & (C("skipped_rows") == 0), 0.95)
                  .when(C("accuracy").isNotNull(), F.when(
                      C("rows") > 0, F.bround((C("accuracy") + share) / 2, 3)).otherwise(0.0))
                  .otherwise(F.least(share, F.coalesce(cap, L(1.0)))))
    return counts.select("file", "parser_id", "rows", "valid_rows", "skipped_rows",
                         confidence.alias("confidence"))


def recommend_parser(quality: DataFrame) -> DataFrame:
    """Per file the reader with most rows, then fewest skipped, then in reader order.

    Readers flagged missing_dependency count only where no other reader ran.
    """
    place = F.array_position(F.array(*[L(r) for r in READER_ORDER]), C("parser_id"))
    available = (~F.coalesce("missing_dependency", L(False))
                 if "missing_dependency" in quality.columns else L(True))
    rank = F.struct(available.alias("available"), "rows", (-C("skipped_rows")).alias("skipped"),
                    (-place).alias("place"))
    return quality.groupBy("file").agg(
        F.max_by("parser_id", rank).alias("recommended"), F.max("rows").alias("max_rows"))


_PARSED = ("file", "parser_id", "transaction_date", "merchant_name", "amount",
           "transaction_type", "error")


def run_parsers(inputs: dict[str, DataFrame], *read: DataFrame) -> DataFrame:
    """Rows of several readers as one table; inputs: reader id -> its extracted rows, `read`:
    rows that have their parser_id."""
    tables = [rows.withColumn("parser_id", L(name)).select(*_PARSED)
              for name, rows in inputs.items()] + [rows.select(*_PARSED) for rows in read]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
