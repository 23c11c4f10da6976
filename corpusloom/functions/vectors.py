"""Functions of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fake_int8(v: str | Column) -> Column:
    """Rounded to the 255 levels of int8 with one scale per row, and back; halves go to the even level."""
    v = F.col(v) if isinstance(v, str) else v
    scale = 127.0 / F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(1e-10))
    return F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(x.cast("double") * scale))) / scale)
