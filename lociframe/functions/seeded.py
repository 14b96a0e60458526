"""Seeded draws from digests of stable ids, so that results do not depend on partitioning or row order.

A draw is the first 60 bits of the MD5 digest of seed, purpose and ids joined by bars (null: ``~``), so that any
engine with that digest draws alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A long from 0 to 2**60 that orders rows at random but the same way each time."""
    cols = [F.coalesce((F.col(i) if isinstance(i, str) else i).cast("string"), F.lit("~")) for i in ids]
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}|{purpose}"), *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def unit(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A double in [0, 1)."""
    return F.pmod(draw(seed, purpose, *ids), F.lit(1 << 52)).cast("double") / float(1 << 52)


def pick(n: Column, seed: int, purpose: str, *ids: Column | str) -> Column:
    """A whole number in [0, n)."""
    return F.pmod(draw(seed, purpose, *ids), n)
