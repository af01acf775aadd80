"""Orders and draws that depend only on a seed and on keys, never on partitions or attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts) -> Column:
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def order_key(*parts) -> Column:
    """Hexadecimal digest that sorts rows in a seeded order."""
    return F.md5(_joined(parts))


def uniform_draw(*parts) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(F.md5(_joined(parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
