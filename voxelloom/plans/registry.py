"""Operators by name, for jobs that name their operator and its arguments."""

from __future__ import annotations

from collections.abc import Callable

from voxelloom.operators import blocks, fields, filters, labels, local, manifest, pyramid, register, select, spots, stats, stitch, warp
from voxelloom.plans import registration

_MODULES = {
    "blocks": blocks, "fields": fields, "filters": filters, "labels": labels, "local": local, "manifest": manifest,
    "pyramid": pyramid, "register": register, "select": select, "spots": spots, "stats": stats, "stitch": stitch,
    "warp": warp, "registration": registration,
}


def operator(name: str) -> Callable:
    """'module.function' -> the operator."""
    module, _, fn = name.partition(".")
    found = getattr(_MODULES.get(module), fn, None)
    if not callable(found) or fn.startswith("_"):
        raise KeyError(f"no operator {name!r}")
    return found


def run_op(name: str, inputs: list, params: dict | None = None):
    """Run a named operator on input frames with keyword parameters."""
    return operator(name)(*inputs, **(params or {}))
