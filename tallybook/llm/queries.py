"""The registered queries of the operators and their DuckDB texts."""

from __future__ import annotations

from tallybook.llm import (alignment, chat, context_tree, decontaminate, forest, near_dedup, pii,
                           quality, token_files, toxicity, unigram, variants, voronoi)
from tallybook.llm.common import table

QUERIES = {
    "op1_decontaminate": lambda s, d: decontaminate.contaminated(
        table(s, d, "documents"), table(s, d, "benchmark")),
    "op2_near_dedup": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op4_chat": lambda s, d: chat.digests(chat.formatted(
        chat.with_planted(table(s, d, "conversations")))),
    "op5_sentencepiece": lambda s, d: unigram.encoded(
        table(s, d, "documents").select("doc_id", "text")).drop("text"),
    "op6_neighbours": lambda s, d: forest.nearest(table(s, d, "embeddings")),
    "op7_pii": lambda s, d: pii.private(table(s, d, "documents")),
    "op8_context_tree": lambda s, d: context_tree.scored(table(s, d, "documents")),
    "op9_token_files": lambda s, d: token_files.token_output(table(s, d, "documents")),
    "op10_quality": lambda s, d: quality.quality(table(s, d, "documents"), table(s, d, "labels")),
    "op11_variants": lambda s, d: variants.spelling_variants(table(s, d, "documents")),
    "op12_voronoi": lambda s, d: voronoi.top_products(table(s, d, "embeddings")),
    "op13_alignment": lambda s, d: alignment.alignment(table(s, d, "documents")),
}

SQL = {
    "op2_near_dedup": near_dedup.SQL,
    "op4_chat": chat.SQL,
    "op11_variants": variants.SQL,
    "op12_voronoi": voronoi.SQL,
}
