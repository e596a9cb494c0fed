"""Registered statement-reading queries."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from tallybook.functions.dates import first_line, read_statement_date
from tallybook.functions.money import parse_statement_amount
from tallybook.functions.text import computed_once, stripped
from tallybook.operators import statements as op
from tallybook.session import cut_lineage, shared_folder
from tallybook.sources import derived
from tallybook.sources import statements as src
from tallybook.sources.ofx_files import scan_ofx_files

C, L = F.col, F.lit
AS_OF = date(2001, 8, 1)


def _lines(s, d, **options):
    return op.extract_lines(src.statement_lines(s, d), AS_OF, **options)


def _years(s, d):
    """The year each file's own text gives, for dates without one."""
    return op.infer_year(src.statement_lines(s, d), AS_OF)


def _cells(s, d, **options):
    return op.extract_cells(src.statement_cells(s, d), _years(s, d), **options)


def _dates(s, d):
    cells = src.statement_cells(s, d).join(_years(s, d), "file").select(
        "file", "row_no", "year", F.posexplode("cells").alias("place", "cell"))
    lines = computed_once(computed_once(cells, stripped("cell").alias("text")),
                          first_line(C("text")).alias("line"))
    return lines.select("file", "row_no", "place",
                        read_statement_date(C("line"), C("year")).alias("day"))


def _profiles(s, d):
    return op.detect_profile(src.statement_words(s, d), AS_OF)


def _word_lines(s, d):
    """The words gathered by line, stored: several steps read them."""
    return cut_lineage(op.word_lines(src.statement_words(s, d)))


def _fixed(s, d):
    lines = _word_lines(s, d)
    layouts = lines.select("file", "page").distinct().join(
        op.detect_profile(lines, AS_OF).select(
            "file", op.fixed_layout(C("number")).alias("layout"), "year"), "file")
    return op.extract_words(lines, layouts)


def _layouts(s, d):
    flat = [F.col(f"layout.{f}.{b}").alias(f"{f}_{b}") for f in op.LAYOUT_FIELDS
            for b in ("lo", "hi")]
    lines = _word_lines(s, d)
    return op.infer_layout(lines, op.detect_profile(lines, AS_OF)).select(
        "file", "page", "from_page", *flat)


def _chosen(s, d):
    lines = _word_lines(s, d)
    profiles = cut_lineage(op.detect_profile(lines, AS_OF))
    inferred = cut_lineage(op.infer_layout(lines, profiles))
    return op.best_layout(op.both_layouts(lines, profiles, inferred), inferred)


def _plain_parsed(s, d):
    """Every reader but the word-box one; readers of the same input share one pass over it."""
    tables = op.read_cells(src.statement_cells(s, d), _years(s, d), {
        "pdfplumber_table": {},
        "camelot_stream": {"skip_zero": True, "short_rows": True, "one_line": False}})
    texts = op.read_lines(src.statement_lines(s, d), AS_OF, {
        "pdfplumber_text": {}, "tesseract": {"two_amounts": False, "credit_words": None}})
    return op.run_parsers({"ofx_parser": op.scan_ofx(derived.ofx_files(s, d))}, tables, texts)


def _all_parsed(s, d):
    boxes = op.run_parsers({
        "pdfplumber_coords": op.read_statements(src.statement_words(s, d), AS_OF)})
    return _plain_parsed(s, d).unionByName(boxes)


def _ofx_from_files(s, d):
    """The texts of all OFX files written one behind the other, read record by record."""
    folder = f"{shared_folder(s)}/ofx-{uuid.uuid4().hex}"
    derived.ofx_files(s, d).select("content").write.text(folder)
    return scan_ofx_files(s, [folder]).drop("path", "file", "statement_no", "position")


QUERIES = {
    "x1_scan_ofx_files": _ofx_from_files,
    "x1_scan_ofx": lambda s, d: op.scan_ofx(derived.ofx_files(s, d)).drop("transaction_type"),
    "x2_ofx_type": lambda s, d: op.scan_ofx(derived.ofx_files(s, d)).select(
        "file", "position", "transaction_type"),
    "p1_statement_lines": _lines,
    "p1_scanned_lines": lambda s, d: _lines(
        s, d, credit_words=op.SCAN_CREDIT_WORDS),
    "p2_infer_year": lambda s, d: op.infer_year(src.statement_lines(s, d), AS_OF),
    "p3_statement_date": _dates,
    "p4_statement_amount": lambda s, d: src.statement_cells(s, d).select(
        "file", "row_no", F.posexplode("cells").alias("place", "cell")).select(
        "file", "row_no", "place", parse_statement_amount(C("cell")).alias("amount")),
    "p5_skip_row": lambda s, d: src.statement_lines(s, d).select(
        # what follows the date of a dated line, else the whole line
        "file", "line_no", op.skip_row(F.coalesce(
            F.nullif(F.regexp_extract("text", op.LINE, 2), L("")), "text")).alias("skipped")),
    "p6_table_cells": _cells,
    "p7_word_boxes": _fixed,
    "p8_detect_profile": _profiles,
    "p9_inferred_layout": _layouts,
    "p10_best_layout": _chosen,
    "p11_parse_quality": lambda s, d: op.parse_quality(_plain_parsed(s, d)),
    "p12_recommend_parser": lambda s, d: op.recommend_parser(op.parse_quality(_plain_parsed(s, d))),
    "p14_run_parsers": _all_parsed,
}
