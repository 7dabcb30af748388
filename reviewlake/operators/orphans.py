"""References to records that do not exist: a range-partitioned orphan probe.

Parents are one row per key with the first day they were there and whether they
were withdrawn. Their keys are cut into ranges of about equal numbers of keys;
each range is one sorted array. References are routed to the range of their key
by a binary search over the range bounds, and every batch of a range is probed
against its array with one vectorised binary search.

Skew: one key may hold a third of all references. A range that gets more than
``batch_rows`` references is split into slices by a hash of the reference id,
and only the small array of parents is repeated for each slice, so no task ever
holds more than about ``batch_rows`` references.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.session import cut

#: Identity kinds of a record, in order of precedence.
IDENTITY_KINDS = ("doi", "source_id", "oa_url")

PERIOD_FORMAT = "yyyy-MM"
#: Sampled keys per range for the choice of the bounds.
SAMPLES_PER_RANGE = 16


def strip_blanks(value: Column) -> Column:
    """``value`` without outer white space of any kind."""
    return F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def doi_key(value: Column) -> Column:
    """A DOI without outer blanks, letter case, resolver address, label and closing dots and blanks."""
    text = F.lower(strip_blanks(value))
    text = F.regexp_replace(text, r"^(?:(?:https?://)?(?:[\w.-]*\bdoi\b[\w.-]*)/+|doi:?[\s\p{Z}]*)+(?=10\.|[\s\p{Z}]*$)", "")
    return F.regexp_replace(text, r"[.\s\p{Z}]+$", "")


def identity_key(kind: Column, value: Column) -> Column:
    """The form of an identifier under which records and references compare."""
    return F.when(kind == "doi", doi_key(value)).otherwise(strip_blanks(value))


def candidate_parents(candidates: DataFrame) -> DataFrame:
    """``kind, key, first_day``: each identifier that candidates bear, with the earliest day of retrieval."""
    day = F.to_date(F.substring(strip_blanks(F.col("date")), 1, 10))
    one = candidates.select(
        day.alias("day"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in IDENTITY_KINDS])).alias("i"),
    )
    keyed = one.select(F.col("i.kind").alias("kind"), identity_key(F.col("i.kind"), F.col("i.value")).alias("key"), "day")
    return keyed.filter("key <> ''").groupBy("kind", "key").agg(F.min("day").alias("first_day"))


def withdrawn_keys(withdrawn: DataFrame) -> DataFrame:
    """``kind, key``: the identifiers taken out of the corpus."""
    kind = kind_of(F.col("identity_type"))
    return withdrawn.select(kind.alias("kind"), identity_key(kind, F.col("doc")).alias("key")).filter("key <> ''").distinct()


def kind_of(identity_type: Column) -> Column:
    """An absent or blank identity_type means ``doi``."""
    named = strip_blanks(identity_type)
    return F.when(named.isNull() | (named == ""), F.lit("doi")).otherwise(named)


def _probe(key: tuple, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    out = refs[["ref_id", "ref_day"]].copy()
    wanted = refs["key"].to_numpy(object)
    order = np.argsort(parents["key"].to_numpy(object), kind="stable") if len(parents) else np.array([], int)
    keys = parents["key"].to_numpy(object)[order].astype(object)
    if len(keys):
        at = np.searchsorted(keys, wanted)
        hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)
        at = np.where(hit, at, 0)
        first = pd.to_datetime(parents["first_day"]).to_numpy()[order][at]
        gone = parents["gone"].to_numpy(bool)[order][at] & hit
        there = hit & ~pd.isnull(first)
        day = pd.to_datetime(refs["ref_day"]).to_numpy()
        # An unreadable day of the reference cannot lie before the retrieval: the record counts as there.
        late = there & ~pd.isnull(day) & (first > day)
    else:
        there = late = gone = np.zeros(len(refs), bool)
    out["verdict"] = np.where(late, "late", np.where(there, "", np.where(gone, "deleted", "missing")))
    return out[out["verdict"] != ""][["ref_id", "verdict"]]


def find_orphans(references: DataFrame, candidates: DataFrame, withdrawn: DataFrame, ranges: int | None = None, keys_per_range: int = 200_000, batch_rows: int = 200_000) -> DataFrame:
    """The references whose record is not, not yet or no longer there.

    ``references`` has ``ref_id``, ``kind``, ``key`` (see :func:`identity_key`) and ``ref_day``.
    Result: ``ref_id, verdict`` with verdict ``late`` (the record was retrieved after
    the day of the reference), else ``deleted`` (withdrawn), else ``missing``.

    Defined cases: a null or blank key is not a reference and is left out; a parent
    without a readable day counts as never retrieved; a reference without a readable day
    is never ``late``; repeated references are judged one by one; with no parents every
    reference is ``deleted`` or ``missing``; extra columns are ignored. ``ref_id`` must be unique.
    """
    parents = candidate_parents(candidates).join(withdrawn_keys(withdrawn).withColumn("gone", F.lit(True)), ["kind", "key"], "full").select(F.concat_ws("\u0001", "kind", "key").alias("key"), "first_day", F.coalesce("gone", F.lit(False)).alias("gone"))
    refs = references.filter("key is not null and key <> '' and kind is not null").select("ref_id", F.concat_ws("\u0001", "kind", "key").alias("key"), "ref_day")

    # Parents are computed once; the number of ranges follows the number of their keys, so no array grows with the data.
    parents = cut(parents)
    total = parents.count()
    n = ranges or max(1, -(-total // keys_per_range))
    bounds: list[str] = []
    if n > 1:
        # A few sampled keys per range fix where the ranges lie; any bounds give right results.
        take = min(1.0, SAMPLES_PER_RANGE * n / max(total, 1))
        some = sorted(r[0] for r in parents.select("key").sample(take, seed=7).limit(2 * SAMPLES_PER_RANGE * n).collect())
        bounds = sorted({some[(i * len(some)) // n] for i in range(1, n)}) if some else []
    place = _range_of(F.col("key"), bounds)
    refs = refs.withColumn("r", place)
    parents = parents.withColumn("r", place)
    # One row per range: the list is as long as the parents are many keys divided by ``keys_per_range``.
    load = {row["r"]: row["n"] for row in refs.groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = {r: -(-k // batch_rows) for r, k in load.items() if k > batch_rows}
    if hot:
        sliced = F.broadcast(references.sparkSession.createDataFrame(sorted(hot.items()), "r int, width int"))
        refs, parents = (side.join(sliced, "r", "left").withColumn("width", F.coalesce("width", F.lit(1))) for side in (refs, parents))
    else:
        refs, parents = (side.withColumn("width", F.lit(1)) for side in (refs, parents))
    refs = refs.withColumn("s", F.pmod(F.xxhash64("ref_id"), F.col("width")).cast("int")).drop("width")
    parents_s = parents.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).drop("width")
    kind = references.schema["ref_id"].dataType.simpleString()
    return refs.groupBy("r", "s").cogroup(parents_s.groupBy("r", "s")).applyInPandas(_probe, f"ref_id {kind}, verdict string")


def _range_of(key: Column, bounds: list[str]) -> Column:
    """The number of the range that holds ``key``: a binary search over the bounds, as nested conditions while they are few."""
    if not bounds:
        return F.lit(0)
    if len(bounds) > 64:
        cuts = np.array(bounds, object)

        @F.pandas_udf("int")
        def place(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, keys.to_numpy(object), side="right").astype("int32"))

        return place(key)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def utc_day(ts: Column) -> Column:
    """The UTC day of an ISO time stamp with any offset; without an offset it is UTC."""
    return F.to_date(F.to_utc_timestamp(F.try_to_timestamp(ts), F.current_timezone()))


def journal_references(decisions: DataFrame) -> DataFrame:
    """The references that journal lines make: ``ref_id`` (seq), ``kind``, ``key``, ``ref_day``."""
    kind = kind_of(F.col("identity_type"))
    # A blank doc names no record; a doc of which only a label is left names one that nobody bears.
    key = identity_key(kind, F.col("doc"))
    named = strip_blanks(F.col("doc")) != ""
    return decisions.filter(named).select(
        F.col("seq").alias("ref_id"), kind.alias("kind"), F.when(key == "", F.lit("\u0002")).otherwise(key).alias("key"), utc_day(F.col("ts")).alias("ref_day")
    )


def journal_orphans(decisions: DataFrame, candidates: DataFrame, withdrawn: DataFrame, **settings: int) -> DataFrame:
    """Journal lines whose record is not there: ``seq, kind`` (see :func:`find_orphans`)."""
    return find_orphans(journal_references(decisions), candidates, withdrawn, **settings).select(F.col("ref_id").alias("seq"), F.col("verdict").alias("kind"))


def orphan_report(decisions: DataFrame, candidates: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Orphans counted per table and period: ``table_name, period, kind, orphan_lines``.

    The period is the UTC month of the line; a line without a readable time is under a null period.
    """
    found = journal_orphans(decisions, candidates, withdrawn)
    when = decisions.select("seq", F.date_format(utc_day(F.col("ts")), PERIOD_FORMAT).alias("period"))
    return found.join(when, "seq").groupBy(F.lit("decisions").alias("table_name"), "period", "kind").agg(F.count(F.lit(1)).alias("orphan_lines"))
