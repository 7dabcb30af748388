"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is cut into slices if it has more rows than a slice holds and at least this share of all rows, so the list of such keys has at most ``1 / HOT_SHARE`` rows.
HOT_SHARE = 1e-5
#: A block of a pair join is cut if it makes more pairs than this; at most so many blocks, the largest ones, are.
BLOCK_PAIRS, MOST_BLOCKS = 4_000_000, 100_000


def join_hot(rows: DataFrame, once: DataFrame, keys: list[str], weight: str, spread: str, total: float, per_slice: int = 50_000, max_slices: int = 1024, hint: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``once``, which has one row per key and the number of its rows in ``weight``.

    Keys with more than ``per_slice`` rows (and ``HOT_SHARE`` of all) are cut into slices of about ``per_slice``
    rows by a hash of the column ``spread``; the one row of ``once`` is repeated per slice.
    The list of those keys is broadcast: it has at most ``1 / HOT_SHARE`` rows of key width. ``hint`` names the join strategy
    for ``once``.
    """
    least = max(float(per_slice), HOT_SHARE * max(total, 1.0))
    slices = F.least(F.lit(max_slices), F.greatest(F.lit(1), F.ceil(F.col(weight) / per_slice))).cast("int")
    hot = F.broadcast(once.filter(F.col(weight) >= least).select(*keys, slices.alias("_slices")))
    left = rows.join(hot, keys, "left").withColumn("_s", F.pmod(F.xxhash64(spread), F.coalesce("_slices", F.lit(1))).cast("int")).drop("_slices")
    right = once.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) >= least, slices).otherwise(1) - 1)))
    return left.join(right.hint(hint) if hint else right, [*keys, "_s"]).drop("_s")


def join_blocks(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Inner join of two sides that both repeat keys: ``left`` and ``right`` columns of all pairs under a key.

    A block of more than ``block_pairs`` pairs becomes a grid of smaller ones: the rows of either side are cut into slices by a
    hash of their id, and each slice meets all slices of the other side. The ``MOST_BLOCKS`` largest blocks at most are cut, so their
    list can be broadcast; the result is the same with and without.
    """
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key)
    edge = max(1, int(block_pairs**0.5))
    large = sizes.filter(F.col("_l") * F.col("_r") > block_pairs).orderBy((F.col("_l") * F.col("_r")).desc()).limit(MOST_BLOCKS)
    cuts = F.broadcast(large.select(key, F.ceil(F.col("_l") / edge).cast("int").alias("_nl"), F.ceil(F.col("_r") / edge).cast("int").alias("_nr")))

    def grid(side: DataFrame, ident: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        out = side.join(cuts, key, "left").withColumn(mine, F.pmod(F.xxhash64(ident), F.coalesce(own, F.lit(1))).cast("int"))
        return out.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_nl", "_nr")

    a = grid(left, left_id, "_nl", "_nr", "_a", "_b")
    b = grid(right, right_id, "_nr", "_nl", "_b", "_a")
    return a.join(b, [key, "_a", "_b"]).drop("_a", "_b")
