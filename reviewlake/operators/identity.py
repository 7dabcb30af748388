"""Identities of records and the components that shared identities form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import nonblank
from reviewlake.operators.skew import join_hot
from reviewlake.session import cut, forget

KINDS = ("doi", "source_id", "oa_url")


def row_identity() -> Column:
    """``identity_type, doc``: the first identifier that is not blank, in the order of ``KINDS``."""
    kind = F.coalesce(*[F.when(nonblank(k).isNotNull(), F.lit(k)) for k in KINDS])
    return F.struct(kind.alias("identity_type"), F.coalesce(*[nonblank(k) for k in KINDS]).alias("doc"))


def identity_values() -> Column:
    """All identifiers that are not blank, as ``kind, value`` in the order of ``KINDS``."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), nonblank(k).alias("value")) for k in KINDS]), lambda x: x["value"].isNotNull())


def exploded_identities(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, kind, value``: one row per row and identifier."""
    return rows.select(key, F.explode(identity_values()).alias("i")).select(key, "i.kind", "i.value")


def latest_by_identity(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``kind, value, key``: for each identifier the last row that bears it."""
    return exploded_identities(rows, key).groupBy("kind", "value").agg(F.max(key).alias(key))


class NotConverged(RuntimeError):
    """Labels still changed after the allowed number of rounds."""


def connected_components(rows: DataFrame, key: str = "row_id", max_rounds: int = 200) -> DataFrame:
    """``key, component``: rows that share an identifier, directly or through others; the component is its smallest key.

    Labels travel over the two-sided graph of rows and identifiers: each identifier takes the smallest label of
    its rows, each row the smallest of its identifiers, then labels are replaced by the labels of the rows they name
    (pointer jumping), so the number of rounds grows with the logarithm of the longest chain. Each round is written to
    the checkpoint folder. Minima combine before the shuffle, and an identifier or a label that many rows share (a placeholder, a
    giant component) is spread over slices when labels come back. Rows without identifiers are components of their own. A graph that needs more than
    ``max_rounds`` rounds raises :class:`NotConverged`; no unfinished labels are returned.
    """
    edges = cut(exploded_identities(rows, key).select(F.col(key).alias("k"), F.xxhash64("kind", "value").alias("v1"), F.xxhash64("value", "kind").alias("v2")).distinct())
    total = float(edges.count())
    labels = rows.select(F.col(key).alias("k"), F.col(key).alias("label"))
    shared = edges.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Identifiers of one row join nothing: only shared ones matter from here on.
    live = cut(join_hot(edges, shared, ["v1", "v2"], "n", "k", total).select("k", "v1", "v2", "n"))
    forget(edges)
    if live.isEmpty():
        return labels.select(F.col("k").alias(key), F.col("label").alias("component"))
    state = cut(live.select("k", F.col("k").alias("label")).distinct())
    for _ in range(max_rounds):
        by_value = live.join(state, "k").groupBy("v1", "v2").agg(F.min("label").alias("m"), F.count(F.lit(1)).alias("n"))
        back = join_hot(live.drop("n"), by_value, ["v1", "v2"], "n", "k", total)
        near = cut(back.groupBy("k").agg(F.min("m").alias("label")))
        # The label of the row that a label names can only be smaller. All rows of a giant component may bear one label.
        named = near.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(near.select(F.col("k").alias("label"), F.col("label").alias("up")), "label")
        new = cut(join_hot(near, named, ["label"], "n", "k", total).select("k", F.least("label", "up").alias("label")))
        forget(near)
        done = new.join(state.withColumnRenamed("label", "old"), "k").filter("label <> old").isEmpty()
        forget(state)
        state = new
        if done:
            return labels.select("k").join(state, "k", "left").select(F.col("k").alias(key), F.coalesce("label", "k").alias("component"))
    raise NotConverged(f"components still change after {max_rounds} rounds")
