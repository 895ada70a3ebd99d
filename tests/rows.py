"""Rows of a pandas frame as sorted plain tuples, for comparison without order."""

from __future__ import annotations

import math


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return str(int(v)) if math.isfinite(v) and v == int(v) else f"{v:.6g}"
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return str(v)


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))
