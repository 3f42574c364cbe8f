"""The thin queries over the operators of this subpackage, and the oracle SQL where SQL can express one."""

from __future__ import annotations

from functools import wraps

from spanweave.llm import (
    op01_revisits,
    op02_embedding_dedup,
    op03_decontaminate,
    op04_jaccard_join,
    op05_lm_score,
    op06_token_counts,
    op07_pseudonyms,
    op08_quality,
    op09_sentencepiece,
    op10_sharding,
    op11_packing,
    op12_collocations,
    op13_resample,
)
from spanweave.llm.text import small_batches

_MODULES = [op01_revisits, op02_embedding_dedup, op03_decontaminate, op04_jaccard_join, op05_lm_score, op06_token_counts, op07_pseudonyms, op08_quality, op09_sentencepiece, op10_sharding, op11_packing, op12_collocations, op13_resample]



def _lean(query):
    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {k: _lean(v) for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
