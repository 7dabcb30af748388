"""Merging of records: shared identity, equal title, similar title; best row and audit of each group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import nonblank, normalize_title, parse_year
from reviewlake.functions.udfs import ratio
from reviewlake.operators.identity import connected_components, identity_values
from reviewlake.operators.skew import join_hot
from reviewlake.session import cut, forget, parallel

THRESHOLD = 0.90
TILE = 1000
#: Titles are laid out in cells of one year and so many characters.
BAND = 16
#: Tiles of one part that a task reads, and tiles that a worker keeps laid out, up to 3 MB each.
PART_TILES, KEPT_TILES = 300, 64
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def quality() -> Column:
    """What makes a row the best of its group: abstract, open copy, later year."""
    return F.struct(nonblank("abstract").isNotNull().alias("a"), nonblank("oa_url").isNotNull().alias("o"), F.coalesce(parse_year("year"), F.lit(0)).alias("y"))


def merge_groups(rows: DataFrame, groups: DataFrame, key: str = "row_id", group: str = "component") -> DataFrame:
    """``group, best, first, members``: the best row of each group (the first of equals), its place (the first row), its size."""
    joined = rows.select(key, quality().alias("q")).join(groups, key)
    return joined.groupBy(group).agg(F.max_by(F.col(key), F.struct("q", -F.col(key))).alias("best"), F.min(key).alias("first"), F.count(F.lit(1)).alias("members"))


def _first_fit(years: Column) -> Column:
    """``y, component`` of the distinct years of one title, an array of (first row, year) in the order of the rows.

    A year joins the first group to all of whose years it is equal or adjacent; an unknown year fits everywhere. Ranges only grow, so a
    group that was closed to a year stays closed to it. The component is the first row of the group.
    """
    state = "struct<lows:array<int>,highs:array<int>,firsts:array<bigint>,out:array<struct<y:int,component:bigint>>>"
    start = F.from_json(F.lit('{"lows":[],"highs":[],"firsts":[],"out":[]}'), state)

    def step(acc: Column, x: Column) -> Column:
        y, first = x["y"], x["first"]
        fits = F.zip_with(acc["lows"], acc["highs"], lambda lo, hi: F.coalesce(y.isNull() | lo.isNull() | ((hi - y <= 1) & (y - lo <= 1)), F.lit(False)))
        at = F.array_position(fits, True).cast("int")
        new = at == 0
        lows = F.when(new, F.concat(acc["lows"], F.array(y))).otherwise(F.transform(acc["lows"], lambda v, i: F.when(i + 1 == at, F.least(v, y)).otherwise(v)))
        highs = F.when(new, F.concat(acc["highs"], F.array(y))).otherwise(F.transform(acc["highs"], lambda v, i: F.when(i + 1 == at, F.greatest(v, y)).otherwise(v)))
        own = F.when(new, first).otherwise(F.try_element_at(acc["firsts"], F.greatest(at, F.lit(1))))
        firsts = F.when(new, F.concat(acc["firsts"], F.array(first))).otherwise(acc["firsts"])
        return F.struct(lows.alias("lows"), highs.alias("highs"), firsts.alias("firsts"), F.concat(acc["out"], F.array(F.struct(y.alias("y"), own.alias("component")))).alias("out")).cast(state)

    return F.aggregate(years, start, step)["out"]


def title_groups(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, component``: rows of the same normalised title whose years fit together (equal, adjacent or unknown), first fit in row order.

    Rows are collapsed to the years of each title first, at most 201 of them, so a title that a third of all rows bears is
    no large group; the years are folded inside one expression, and hot titles are spread over slices on the way back. Blank titles are not grouped.
    """
    keyed = cut(parallel(rows.select(key, "title", "year"), key).select(key, normalize_title("title").alias("title_key"), parse_year("year").alias("y")).filter("title_key <> ''"))
    years = keyed.groupBy("title_key", "y").agg(F.min(key).cast("long").alias("first"), F.count(F.lit(1)).alias("n"))
    titles = years.groupBy("title_key").agg(F.array_sort(F.collect_list(F.struct("first", "y"))).alias("ys"), F.sum("n").alias("n"))
    # A title with one year is one group, in whatever order.
    one = titles.filter(F.size("ys") == 1).select("title_key", F.array(F.struct(F.col("ys")[0]["y"].alias("y"), F.col("ys")[0]["first"].alias("component"))).alias("out"), "n")
    several = titles.filter(F.size("ys") > 1).select("title_key", _first_fit(F.col("ys")).alias("out"), "n")
    placed = one.unionByName(several).select("title_key", "n", F.explode("out").alias("g")).select("title_key", F.coalesce("g.y", F.lit(0)).alias("y0"), "g.component", "n")
    met = join_hot(keyed.withColumn("y0", F.coalesce("y", F.lit(0))), placed, ["title_key", "y0"], "n", key, float(keyed.count()))
    return met.select(key, F.col("component").cast(rows.schema[key].dataType).alias("component"))


#: Characters are hashed into so many slots; a bound that counts or matches slots stays valid when characters share one.
SLOTS = 64
GRAMS = 512
#: Counts of a slot beyond this one are not laid out one by one.
MOST_COUNT = 12


class Tile:
    """Titles of one tile, laid out for bounds on many pairs at once."""

    def __init__(self, keys: np.ndarray, titles: list[str], years: np.ndarray) -> None:
        self.k, self.t, self.y = keys, titles, years
        self.n = np.array([len(t) for t in titles], np.int64)
        codes = (np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32) % SLOTS).astype(np.uint8)
        #: The slots of each title in order, filled up with a slot that matches nothing.
        self.codes = np.full((len(titles), max(1, self.n.max(initial=0))), SLOTS, np.uint8)
        self.codes[np.arange(self.codes.shape[1]) < self.n[:, None]] = codes
        counts = np.bincount(np.repeat(np.arange(len(titles)), self.n) * SLOTS + codes, minlength=len(titles) * SLOTS).reshape(-1, SLOTS)
        #: Whether a title has a slot at least 1, 2 ... times, so that a product counts what two titles have in common; and what is beyond.
        self.steps = (counts[:, :, None] > np.arange(MOST_COUNT)).reshape(len(titles), -1)
        self.beyond = np.maximum(counts - MOST_COUNT, 0).sum(1)
        own = np.repeat(np.arange(len(titles)), self.n)
        pair = (codes[:-1].astype(np.int64) * 37 + codes[1:]) % GRAMS
        inside = own[:-1] == own[1:]
        #: How often each pair of neighbouring slots is there, hashed too.
        self.grams = np.minimum(np.bincount(own[:-1][inside] * GRAMS + pair[inside], minlength=len(titles) * GRAMS), 255).astype(np.uint8).reshape(-1, GRAMS)
        self.some, self.all = self.steps.any(0), self.steps.all(0)
        self._places: np.ndarray | None = None

    def places(self) -> np.ndarray:
        """For each title and slot the places of the slot as bits of several numbers."""
        if self._places is None:
            words = -(-self.codes.shape[1] // 64)
            self._places = np.zeros((len(self.t), SLOTS + 1, words), np.uint64)
            row, col = np.nonzero(self.codes < SLOTS)
            np.add.at(self._places, (row, self.codes[row, col], col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
        return self._places


def _subsequences(left: Tile, right: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of slots for each pair, by bits of the places that are not matched yet, for all pairs at once."""
    places = left.places()
    words = places.shape[2]
    row = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
    for at in range(right.codes.shape[1]):
        hits = places[i, right.codes[j, at]]
        carry = np.zeros(len(i), bool)
        for w in range(words):
            hit = row[w] & hits[:, w]
            total = row[w] + hit + carry
            over = (total < row[w]) | (carry & (total == row[w]))
            row[w] = total | (row[w] & ~hit)
            carry = over
    return 64 * words - sum(np.bitwise_count(x).astype(np.int64) for x in row)


def similar_in_tiles(left: Tile, right: Tile, same: bool, threshold: float) -> list[tuple[int, int, float]]:
    """The similar pairs of two tiles as earlier row, later row, ratio: character bound, year rule, bounds on neighbours and subsequence, then the exact ratio (later row first). All bounds are lossless."""
    # What all titles of a side have, the pair has in common if the other one has it: that needs no product.
    use = left.some & right.some & ~left.all & ~right.all
    sure_l, sure_r = left.steps[:, right.all & ~left.all].sum(1) + left.beyond, right.steps[:, left.all].sum(1)
    a, b = left.steps[:, use].astype(np.float32), np.ascontiguousarray(right.steps[:, use].T, np.float32)
    near = []
    for at in range(0, len(left.t), 256):
        part = slice(at, at + 256)
        common = a[part] @ b
        common += (sure_l[part] - threshold / 2 * left.n[part]).astype(np.float32)[:, None]
        common += (sure_r - threshold / 2 * right.n).astype(np.float32)
        i, j = np.nonzero(common >= -1e-3)
        near.append((i + at, j))
    i, j = (np.concatenate(x) for x in zip(*near))
    total = left.n[i] + right.n[j]
    # An unknown year fits everywhere.
    ok = ~(np.abs(left.y[i] - right.y[j]) > 1) & (2 * np.minimum(left.n[i], right.n[j]) >= threshold * total)
    if same:
        ok &= j > i
    i, j, total = i[ok], j[ok], total[ok]
    out = []
    for at in range(0, len(i), 20_000):
        x, y, both = i[at : at + 20_000], j[at : at + 20_000], total[at : at + 20_000]
        # At least threshold / 2 of all characters are matched, and each of the others parts at most one pair of matched neighbours.
        ok = np.minimum(left.grams[x], right.grams[y]).sum(1) >= np.minimum((1.5 * threshold - 1) * both - 1 - 1e-9, 200)
        x, y, both = x[ok], y[ok], both[ok]
        ok = 2 * _subsequences(left, right, x, y) >= threshold * both - 1e-9
        for m, n in zip(x[ok].tolist(), y[ok].tolist()):
            (k1, t1), (k2, t2) = sorted(((int(left.k[m]), left.t[m]), (int(right.k[n]), right.t[n])))
            r = ratio(t2, t1)
            if r >= threshold:
                out.append((k1, k2, r))
    return out


def similar_title_pairs(rows: DataFrame, key: str = "row_id", threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, ratio``: pairs of representatives of distinct titles (and years) with a ratio of at least ``threshold``.

    Every representative is the first row of its title and year; copies belong to it and are not expanded into pairs.
    The comparison is exact: titles are put into tiles by year and length, and tiles meet where the year rule and the length bound allow a pair;
    a tile is bounded. Partitions of tiles are read by the tasks that pair them, so the tiles are written once, not once for each tile
    that they meet. Inside, bounds on characters, their neighbours and the common subsequence, all lossless, leave few pairs for the exact ratio. Blank titles are left out.
    """
    named = parallel(rows.select(key, "title", "year"), key).select(key, normalize_title("title").alias("t"), parse_year("year").alias("y")).filter("t <> ''")
    reps = cut(named.groupBy("t", "y").agg(F.min(key).cast("long").alias("k")).withColumn("b", F.floor(F.length("t") / BAND).cast("int")))
    cells = reps.groupBy(F.col("y").alias("cell_y"), F.col("b").alias("cell_b")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    # Cells are years by length bands; a tile has about ``TILE`` titles, as its number is a hash.
    met = reps.join(cells, F.col("y").eqNullSafe(F.col("cell_y")) & (F.col("b") == F.col("cell_b"))).select("k", "t", "y", "b", F.pmod(F.xxhash64("k"), "tiles").cast("int").alias("tile"))
    tiles = cut(met.groupBy("y", "b", "tile").agg(F.collect_list("k").alias("ks"), F.collect_list("t").alias("ts")).withColumn("no", F.monotonically_increasing_id()))
    forget(reps)
    # The square of the parts is the number of tasks; a part is held in memory by the task that reads it.
    count = tiles.count()
    parts = max(1, min(count, math.ceil((4 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5)), -(-count // PART_TILES))
    left, right = (tiles.repartition(parts, "no").select(*[F.col(c).alias(f"{c}{i}") for c in ("no", "y", "b", "ks", "ts")]) for i in (1, 2))
    # The longest title that a pair allows beside one of the band, and so the bands that may meet.
    furthest = F.floor((F.col("b1") * BAND + BAND - 1) * (2 / threshold - 1) / BAND)
    years = F.col("y1").isNull() | F.col("y2").isNull() | (F.abs(F.col("y1") - F.col("y2")) <= 1)
    bands = ((F.col("b1") < F.col("b2")) & (F.col("b2") <= furthest)) | ((F.col("b1") == F.col("b2")) & (F.col("no1") <= F.col("no2")))
    work = left.join(right.hint("shuffle_replicate_nl"), years & bands)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Tile] = {}

        def tile(batch: pa.RecordBatch, at: int, side: int) -> Tile:
            no, year = batch[f"no{side}"][at].as_py(), batch[f"y{side}"][at].as_py()
            if no not in kept:
                if len(kept) >= KEPT_TILES:
                    del kept[next(iter(kept))]
                keys = np.asarray(batch[f"ks{side}"][at].values, np.int64)
                kept[no] = Tile(keys, batch[f"ts{side}"][at].as_py(), np.full(len(keys), np.nan if year is None else year, float))
            return kept[no]

        for batch in batches:
            for at in range(batch.num_rows):
                one, two = tile(batch, at, 1), tile(batch, at, 2)
                found = similar_in_tiles(one, two, batch["no1"][at] == batch["no2"][at], threshold)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b", "ratio"])

    spark = rows.sparkSession
    # A row holds two tiles, so few rows make a batch.
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, "4")
    try:
        pairs = cut(work.mapInArrow(compare, "a bigint, b bigint, ratio double"))
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    forget(tiles)
    return pairs


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """First-fit groups within one component: a row joins the first group with all of whose members it is similar, if at most one identifier is in play."""
    pairs = {(a, b) for a, b in zip(pdf["a"], pdf["b"]) if not pd.isna(b)}
    info = {}
    for side in ("a", "b"):
        for k, d, y in zip(pdf[side], pdf[f"doi_{side}"], pdf[f"y_{side}"]):
            if not pd.isna(k):
                info[int(k)] = (d, None if pd.isna(y) else y)
    groups: list[list[int]] = []
    for k in sorted(info):
        for g in groups:
            dois = {info[m][0] for m in g if info[m][0]}
            own = info[k][0]
            distinct = len(dois | ({own} if own else set()))
            blank = (not own) or any(not info[m][0] for m in g)
            fits = all((min(m, k), max(m, k)) in pairs for m in g)
            if fits and distinct <= 1 and blank:
                g.append(k)
                break
        else:
            groups.append([k])
    return pd.DataFrame([(m, g[0]) for g in groups for m in g], columns=["k", "component"])


def fuzzy_groups(rows: DataFrame, key: str = "row_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key, component``: rows merged by similar titles, first fit in row order within each component of similar pairs.

    At most one distinct DOI may be in a group and at least one row must lack one. ``rows`` are what the title pass left: few rows share a
    title there, so components are small.
    """
    pairs = similar_title_pairs(rows, key, threshold)
    info = rows.select(F.col(key).alias("k"), nonblank("doi").alias("doi"), parse_year("year").alias("y"))
    graph = cut(pairs.join(info.select(F.col("k").alias("a"), F.col("doi").alias("doi_a"), F.col("y").alias("y_a")), "a").join(info.select(F.col("k").alias("b"), F.col("doi").alias("doi_b"), F.col("y").alias("y_b")), "b"))
    if graph.isEmpty():
        return rows.select(key, F.col(key).alias("component"))
    ends = graph.select(F.explode(F.array("a", "b")).alias("row_id"), F.concat_ws(":", "a", "b").alias("doi"))
    comps = connected_components(ends.groupBy("row_id", "doi").agg(F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("oa_url")).select("row_id", "doi", "source_id", "oa_url"), "row_id")
    comps = comps.groupBy("row_id").agg(F.min("component").alias("c"))
    grouped = graph.join(comps.withColumnRenamed("row_id", "a"), "a").groupBy("c").applyInPandas(lambda pdf: _greedy(pdf), "k long, component long")
    return rows.select(key).join(grouped.withColumnRenamed("k", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def apply_groups(rows: DataFrame, groups: DataFrame, key: str = "row_id") -> DataFrame:
    """The best row of each group, with ``place`` (the first row of the group); rows in no group stay."""
    full = rows.select(key).join(groups, key, "left").select(key, F.coalesce("component", key).alias("component"))
    merged = merge_groups(rows, full, key)
    return rows.join(merged.select(F.col("best").alias(key), F.col("first").alias("place"), "members"), key)


def deduplicate(rows: DataFrame, key: str = "row_id", threshold: float = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """The three passes one after the other: shared identity, equal title, similar title. Rows without any identifier must be left out before."""
    one = cut(apply_groups(rows, connected_components(rows, key), key).drop("place", "members"))
    two = cut(apply_groups(one, title_groups(one, key), key).drop("place", "members"))
    forget(one)
    return apply_groups(two, fuzzy_groups(two, key, threshold), key).drop("place", "members") if fuzzy else two


def audit(rows: DataFrame, groups: DataFrame, key: str = "row_id") -> DataFrame:
    """What each group of several rows merged: ids in row order, DOIs, sources, typed records, the best row, the removed count.

    The values of a group are put in one row; they are distinct identifiers, not rows.
    """
    joined = rows.join(groups, key).select(key, "component", "source", F.explode_outer(identity_values()).alias("i"))
    firsts = joined.filter("i is not null").groupBy("component", "i", "source").agg(F.min(key).alias("at"))
    lists = firsts.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", F.col("i.kind").alias("kind"), F.col("i.value").alias("value"), "source"))).alias("xs"), F.sort_array(F.collect_set("source")).alias("merged_sources"))
    merged = merge_groups(rows, groups, key).filter("members > 1")
    return merged.join(lists, "component").select(
        "component",
        "best",
        (F.col("members") - 1).alias("removed"),
        F.array_distinct(F.transform("xs", lambda x: x["value"])).alias("merged_ids"),
        F.array_distinct(F.transform(F.filter("xs", lambda x: x["kind"] == "doi"), lambda x: x["value"])).alias("merged_dois"),
        "merged_sources",
        F.transform("xs", lambda x: F.struct(x["kind"].alias("type"), x["value"].alias("value"), x["source"].alias("source"))).alias("merged_id_records"),
    )


def merge_rates(rows: DataFrame, groups: DataFrame, key: str = "row_id", alarm: float = 0.10) -> DataFrame:
    """``source, records, merged, rate, alarm``: how many rows of each source a pass merged away."""
    full = rows.select(key, "source").join(groups, key, "left").select(key, "source", F.coalesce("component", key).alias("component"))
    best = merge_groups(rows, full.select(key, "component"), key).select(F.col("best").alias(key), F.lit(True).alias("kept"))
    marked = full.join(best, key, "left")
    out = marked.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("kept").isNull()).alias("merged"))
    rate = F.col("merged") / F.col("records")
    return out.select("source", "records", "merged", F.round(rate, 6).alias("rate"), (rate > alarm).alias("alarm"))
