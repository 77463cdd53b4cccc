"""Hashes that any SQL engine can repeat: hex digits of md5."""

from pyspark.sql import functions as F


def md5_uint(text, first, digits):
    """``digits`` hex digits of md5(text), from position ``first``, as a bigint."""
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("bigint")


def uniform(seed, key):
    """A number in (0, 1) fixed by the seed and the key."""
    digest = md5_uint(F.concat(F.lit(f"{seed}:"), key.cast("string")), 1, 13)
    return (digest + 1) / F.lit(float(16**13 + 1))
