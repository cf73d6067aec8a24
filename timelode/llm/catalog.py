"""The registered queries of the subpackage: the catalogues of its modules together."""

from __future__ import annotations

import importlib

MODULES = ("ngram_join", "dedup_exact", "bpe", "packing", "toxicity", "quality", "langid", "ann", "preferences", "url_rules", "whitening", "packing_nnls", "centroids")

QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    _module = importlib.import_module(f"timelode.llm.{_m}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
