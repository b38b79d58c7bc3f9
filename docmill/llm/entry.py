"""The queries of this subpackage and the SQL of those that SQL can say."""

from __future__ import annotations

import importlib

QUERIES = {}
SQL = {}
for _module, _names in (
    ("scan", ("p1_repaired", "p1_found")),
    ("consensus", ("p3_consensus", "p3_found", "p3_reliability")),
    ("textstats", ("p2_stats", "p2_found")),
    ("splitting", ("p4_pieces", "p4_found")),
    ("tokenize", ("p6_ids", "p6_decoded")),
    ("batchdedup", ("p5_found", "p5_last_batch", "p5_coverage")),
    ("language", ("p8_documents", "p8_passages", "p8_found")),
    ("packing", ("p7_containers", "p7_fill")),
):
    _m = importlib.import_module(f"docmill.llm.{_module}")
    QUERIES |= {n: getattr(_m, n) for n in _names}
    SQL |= getattr(_m, "SQL", {})
