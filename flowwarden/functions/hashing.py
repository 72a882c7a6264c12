"""Deterministic identifiers and pseudo-random draws.

MD5 is used because it gives one value on every engine and every run, so splits, samples and ids can
be replayed and checked elsewhere.  It runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*cols: Column, sep: str = "|") -> Column:
    return F.md5(F.concat_ws(sep, *[c.cast("string") for c in cols]))


def digest_int(hexdigest: Column, start: int = 1, digits: int = 8) -> Column:
    """Integer value of ``digits`` hex digits of a digest, from 1-based position ``start``."""
    return F.conv(F.substring(hexdigest, start, digits), 16, 10).cast("bigint")


def draw(*cols: Column, seed: int = 42) -> Column:
    """A fixed uniform draw in [0, 1) per row."""
    return digest_int(digest(F.lit(str(seed)), *cols)) / F.lit(4294967296.0)


def stable_id(prefix: str, *cols: Column) -> Column:
    """Collision-resistant id from row content (an epoch second would collide within a second)."""
    return F.concat(F.lit(prefix + "_"), F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256))
