"""Rows of both engines in one form."""

from __future__ import annotations

import math


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, (bool, str, bytes)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    f = float(v)
    if math.isinf(f):
        return f
    return int(f) if f == int(f) and abs(f) < 1 << 53 else round(f, 6) + 0.0


def rows(pdf) -> list[tuple]:
    columns = sorted(pdf.columns)
    return sorted(zip(*([plain(v) for v in pdf[c].astype(object)] for c in columns), strict=True), key=repr)
