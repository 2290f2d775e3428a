"""The text-corpus queries and the SQL they are checked against."""

from __future__ import annotations

import corpus_pipeline
from quizmill.llm import bpe, counts, jaccard, lattice, packing, pages, phrases, quality, quotes, rans, suffixes, toxicity, trie

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pages": pages.op3_pages,
    "op4_quotes": quotes.op4_quotes,
    "op5_packing": packing.op5_packing,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_lattice": lattice.op7_lattice,
    "op8_rans": rans.op8_rans,
    "op9_quality": quality.op9_quality,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_counts": counts.op11_counts,
    "op12_trie": trie.op12_trie,
    "op13_phrases": phrases.op13_phrases,
    "pipeline": corpus_pipeline.run,
}
ORACLE: dict[str, str] = {
    "op4_quotes": quotes.SQL,
    "op6_suffixes": suffixes.SQL,
    "op7_lattice": lattice.SQL,
    "op9_quality": quality.SQL,
    "op10_jaccard": jaccard.SQL,
    "op12_trie": trie.SQL,
    "op13_phrases": phrases.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
