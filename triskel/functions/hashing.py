"""Hash that gives one value in Spark, SQL and Python.

Random choices hang on (seed, row, item) and not on a generator's state, so they
survive retries and any partitioning.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(2**32)


def _digest(parts: tuple) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash32(*parts) -> Column:
    """Leading 32 bits of md5('a|b|c') as BIGINT."""
    return F.conv(F.substring(_digest(parts), 1, 8), 16, 10).cast("bigint")


def hash32_second(*parts) -> Column:
    """The next 32 bits of the same digest."""
    return F.conv(F.substring(_digest(parts), 9, 8), 16, 10).cast("bigint")


def unit_hash(*parts) -> Column:
    """Uniform in [0, 1)."""
    return hash32(*parts) / F.lit(SPAN)


def py_hash32(*parts) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)
