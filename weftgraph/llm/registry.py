"""The queries of this folder."""

from __future__ import annotations

from weftgraph.catalog import Catalog
from weftgraph.llm import queries_bpe, queries_crossalign, queries_dac, queries_licenses, queries_media, queries_merge_rounds, queries_mixing, queries_ngram, queries_pii, queries_quality, queries_runs, queries_sharding, queries_simhash

LLM_CATALOG = Catalog()
for module in (queries_bpe, queries_crossalign, queries_dac, queries_licenses, queries_media, queries_merge_rounds, queries_mixing, queries_ngram, queries_pii, queries_quality, queries_runs, queries_sharding, queries_simhash):
    for name, one in module.CATALOG.items():
        LLM_CATALOG.add(name, one.sql, one.covers)(one.run)
