"""Deterministic hashes: folds, fractions, digests of sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "20260907"


def hash64(*parts: Column | str, sep: str = "|") -> Column:
    """The first 64 bits of the SHA-256 of the joined parts as decimal(20,0)."""
    text = F.concat_ws(sep, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fold(value: Column, folds: int = 5, seed: str = SEED) -> Column:
    return (hash64(seed, value) % folds).cast("int")


def stable_fraction(value: Column) -> Column:
    """A fraction from 0 to 1 given by the value's hash."""
    return hash64(value).cast("double") / F.lit(float(16**16 - 1))


def rank_key(value: Column, seed: str = SEED) -> Column:
    """Order by seeded hash (then by the value itself)."""
    return F.sha2(F.concat_ws("|", F.lit(seed), value), 256)


def set_digest(df: DataFrame, by: Sequence[str], id_: str, out: str, count: str) -> DataFrame:
    """(<by>, count, out): how many different ids each group has, and a digest of the set of them.

    The digest is the SHA-256 of the count and of four sums, of the 64-bit quarters of the ids' SHA-256, so it doesn't depend on order, parts
    of a group are added up map-side, and no task holds a group's ids. Null ids don't count.
    """
    part = lambda i: F.conv(F.substring(F.sha2(F.col(id_), 256), 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    x = df.where(F.col(id_).isNotNull()).select(*by, id_).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(count), *[F.sum(part(i)).alias(f"__h{i}") for i in range(4)])
    return x.select(*by, count, F.sha2(F.concat_ws("|", F.lit("sum"), F.col(count).cast("string"), *[F.col(f"__h{i}").cast("string") for i in range(4)]), 256).alias(out))


#: The same over a group of different ids, for DuckDB.
SET_DIGEST = "sha256(concat_ws('|', 'sum', count(*)::varchar, " + ", ".join(f"sum(('0x' || substr(sha256({{0}}), {16 * i + 1}, 16))::ubigint::hugeint)::varchar" for i in range(4)) + "))"


def stable_seed(*parts: Column) -> Column:
    """A 31-bit seed from the parts, joined by the unit separator."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))
