"""All registered queries and their SQL checks."""

from __future__ import annotations

import importlib

QUERIES, ORACLES = {}, {}
for _name in ("q_select", "q_manifest", "q_filters", "q_transform", "q_labels", "q_spots", "q_register", "q_stitch", "q_io"):
    _module = importlib.import_module(f"voxelloom.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
