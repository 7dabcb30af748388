"""Best representative of each duplicate group, field by field.

For each field a value is usable or not, and usable values are ranked by how full they
are and how current. Currency is a partial order over the values of a group: dates order what is
dated; for the rest it is learned from the timestamped rows of all groups which kind of value
follows which (a preprint series is followed by a journal series, one host by another). The
topologically latest value is the current one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.session import cut

# What stands in an abstract field instead of an abstract, and page furniture around it.
NOTICES = (
    r"no abstract( is)?( available)?|abstract (is )?(not|un)\s?available|\[?no abstract\]?|see (the )?full[ -]?text|r[ée]sum[ée] (non disponible|indisponible)|"
    r"resumen no disponible|keine? (zusammenfassung|abstract)( verf[üu]gbar)?|tba|tbd|n\W?a|null|none|nan|not available|unavailable|pending|abstract|missing|unknown|to be (added|announced)|"
    r"аннотация отсутствует|抄録なし|要旨なし|无摘要|چکیده موجود نیست"
)
PAGE_NOTICE = (
    r"available to subscribers only|please log ?in|log in through your institution|create an account to continue|use of cookies|skip to main content|"
    r"enable javascript|you do not have access|purchase (this article|access)|access denied|page not found|are you a robot|subscribe to (read|view)"
)
#: Marks that say a text goes on elsewhere; they are no part of it.
CUT_MARKS = r"\[(\.\.\.|…|truncated)\]|\(abstract truncated[^)]*\)|(\.\.\.|…)\s*$"

FIELDS = ("abstract", "oa_url", "year", "doi")


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")


def _bare(value: Column) -> Column:
    """The letters and digits of a value, in small letters; ligatures count as their letters."""
    text = F.lower(value)
    for code, letters in ((0xFB00, "ff"), (0xFB01, "fi"), (0xFB02, "fl"), (0xFB03, "ffi"), (0xFB04, "ffl")):
        text = F.replace(text, F.lit(chr(code)), F.lit(letters))
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def abstract_fullness(abstract: Column, title: Column) -> Column:
    """The number of letters and digits of a genuine abstract, null for what is none."""
    text = F.regexp_replace(_trim(abstract), f"(?i){CUT_MARKS}", "")
    bare, own = _bare(text), _bare(F.coalesce(title, F.lit("")))
    notice = F.lower(text).rlike(rf"^\W*({NOTICES})\W*$") | (F.lower(text).rlike(PAGE_NOTICE))
    # A title repeated, whole or cut, is no abstract; nor is a title with only a mark behind it.
    repeated = (F.length(own) > 0) & ((bare == own) | (F.length(bare) < F.length(own) * 1.15) & bare.startswith(own) | own.startswith(bare))
    return F.when(abstract.isNotNull() & (F.length(bare) >= 12) & ~notice & ~repeated, F.length(bare))


def usable_url(url: Column) -> Column:
    """A complete web address of a document: scheme, host and a path with something in it."""
    text = _trim(url)
    return F.when(text.rlike(r"^(?i:https?)://[^\s/?#.]+(\.[^\s/?#.]+)+(:\d+)?/[^\s]*[^\s/?#][^\s]*$"), text)


def usable_year(year: Column, day: Column) -> Column:
    """Four digits, from 1900 and not after the year of retrieval; null for other values."""
    value = F.when(_trim(year).rlike(r"^\d{4}$"), F.try_to_number(_trim(year), F.lit("9999")).cast("int"))
    return F.when((value >= 1900) & (day.isNull() | (value <= F.year(day))), value)


def usable_doi(doi: Column) -> Column:
    """A DOI with prefix and suffix, bare or behind a label or resolver address; null for other values."""
    text = _trim(doi)
    return F.when(text.rlike(r"(?i)^((https?://)?[\w.-]*\bdoi\b[\w.-]*/+|doi:?\s*)?10\.\d{4,9}(\.\d+)*/[^\s]*[\p{L}\p{N}][^\s]*$"), text)


def value_kind(field: str, row: dict[str, Column]) -> Column:
    """The kind of a value, between which transitions are learned: registrant and series of a DOI, host of an address, the year itself, whether a text is cut."""
    if field == "doi":
        return F.lower(F.regexp_extract(row["doi_ok"], r"(?i)10\.\d{4,9}(?:\.\d+)*/[a-z]*", 0))
    if field == "oa_url":
        return F.lower(F.regexp_extract(row["oa_ok"], r"^(?i:https?)://(?:www\.)?([^/:]+)", 1))
    if field == "year":
        return row["year_ok"].cast("string")
    return F.when(row["cut"], "cut").otherwise("whole")


def usable_values(members: DataFrame, rows: DataFrame, group: str, key: str) -> DataFrame:
    """``group, key, day, loaded, field_name, value, size, kind``: the usable values of the members of groups."""
    day = F.to_date(F.substring(_trim(F.col("date")), 1, 10))
    got = members.select(group, key).filter(F.col(group).isNotNull()).distinct().join(rows.select(key, "title", *FIELDS, day.alias("day"), F.col("loaded_at").alias("loaded")), key)
    seen = got.select(
        group,
        key,
        "day",
        "loaded",
        abstract_fullness(F.col("abstract"), F.col("title")).alias("full"),
        F.coalesce(F.col("abstract").rlike(f"(?i){CUT_MARKS}"), F.lit(False)).alias("cut"),
        usable_url(F.col("oa_url")).alias("oa_ok"),
        usable_year(F.col("year"), F.col("day")).alias("year_ok"),
        usable_doi(F.col("doi")).alias("doi_ok"),
        "abstract",
    )
    row = {c: F.col(c) for c in seen.columns}
    values = (("abstract", F.when(row["full"].isNotNull(), row["abstract"]), row["full"]), ("oa_url", row["oa_ok"], F.lit(0)), ("year", row["year_ok"], F.lit(0)), ("doi", row["doi_ok"], F.lit(0)))
    each = [F.struct(F.lit(f).alias("field_name"), v.cast("string").alias("value"), F.coalesce(size, F.lit(0)).alias("size"), value_kind(f, row).alias("kind")) for f, v, size in values]
    return seen.select(group, key, "day", "loaded", F.explode(F.array(*each)).alias("v")).select(group, key, "day", "loaded", "v.*").filter("value is not null")


def learn_precedence(nodes: DataFrame, group: str) -> DataFrame:
    """``field_name, earlier, later, support``: which kind of value comes before which, from the timestamped rows.

    ``nodes`` has one row per group, field and kind with ``last_day``. A transition is a kind followed in time by the next one
    of the same group. Of two kinds the more frequent direction holds, if it also leads from a kind that is
    rather left to a kind that is rather reached, so there are no circles. The table stays distributed.
    """
    order = W.partitionBy(group, "field_name").orderBy("last_day", "kind")
    steps = nodes.filter("last_day is not null").select("field_name", "kind", "last_day", F.lag("kind").over(order).alias("before"), F.lag("last_day").over(order).alias("day_before"))
    counts = steps.filter("day_before < last_day").groupBy("field_name", F.col("before").alias("earlier"), F.col("kind").alias("later")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.select("field_name", F.col("earlier").alias("kind"), F.col("n").alias("left_n"), F.lit(0).cast("long").alias("reached_n")).unionByName(
        counts.select("field_name", F.col("later").alias("kind"), F.lit(0).cast("long").alias("left_n"), F.col("n").alias("reached_n"))
    )
    place = ends.groupBy("field_name", "kind").agg((F.sum("reached_n") / F.sum(F.col("left_n") + F.col("reached_n"))).alias("place"))
    back = counts.select("field_name", F.col("later").alias("earlier"), F.col("earlier").alias("later"), F.col("n").alias("m"))
    net = counts.join(back, ["field_name", "earlier", "later"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0)))
    low, high = (place.select("field_name", F.col("kind").alias(c), F.col("place").alias(f"{c}_place")) for c in ("earlier", "later"))
    return net.join(low, ["field_name", "earlier"]).join(high, ["field_name", "later"]).filter("earlier_place < later_place").select("field_name", "earlier", "later", F.col("n").alias("support"))


def best_values(members: DataFrame, rows: DataFrame, group: str = "group_id", key: str = "row_id") -> DataFrame:
    """``group, field_name, key, value``: for each group and field the row that holds the best value.

    Only the fullest usable values stay (of fields other than the abstract all are equally full). Their kinds are the nodes of a partial order: a kind
    precedes another if the dates of their rows say so, and where a date is missing or two rows are of one day and loading time, if the precedence learned from
    all groups does (:func:`learn_precedence`). The topologically latest node gives the value; of several
    latest ones a dated one, then the one with the later ``loaded_at``, then the one with the smaller key. Inside a node the row with the latest date, then ``loaded_at``, then the smallest key.
    Groups without a usable value of a field give no row for
    it; repeated memberships count once; members without a row, and null groups, are left out.
    """
    values = usable_values(members, rows, group, key)
    never = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    # One row per group, field and kind, combined before the shuffle, so a group that holds a third of all rows is small here.
    rank = F.struct("size", F.coalesce(F.unix_date("day"), F.lit(-(10**6))), F.coalesce("loaded", never), -F.col(key))
    nodes = values.groupBy(group, "field_name", "kind").agg(F.max("size").alias("size"), F.max(F.struct(rank.alias("rank"), "day", F.coalesce("loaded", never).alias("loaded"), F.col(key).alias(key), "value")).alias("top"), F.max("day").alias("last_day"))
    nodes = cut(nodes.select(group, "field_name", "kind", "size", "last_day", F.col("top.day").alias("day"), F.col("top.loaded").alias("loaded"), F.col(f"top.{key}").alias(key), F.col("top.value").alias("value")))
    known = learn_precedence(nodes, group)
    peers = W.partitionBy(group, "field_name")
    full = nodes.withColumn("most", F.max("size").over(peers)).filter("size = most").drop("most", "last_day")
    latest = F.max(F.when(F.col("day").isNotNull(), F.struct("day", "loaded"))).over(peers)
    # Dates order the dated nodes; only the latest of them, and the undated ones, may be the end of the order.
    placed = full.withColumn("latest", latest).withColumn("open", F.col("day").isNull() | (F.struct("day", "loaded") == F.col("latest")))
    front = placed.filter("open").withColumn("n", F.count(F.lit(1)).over(peers))
    several = front.filter("n > 1")
    # A node of the front is not the latest if its kind is known to precede that of another node of the front, or, being undated, of any node.
    followers = several.alias("a").join(known.alias("k"), (F.col("a.field_name") == F.col("k.field_name")) & (F.col("a.kind") == F.col("k.earlier"))).select(F.col(f"a.{group}").alias(group), "a.field_name", "a.kind", F.col("a.day").isNull().alias("undated"), F.col("k.later").alias("later"))
    beaten = followers.join(placed.select(group, "field_name", F.col("kind").alias("later"), "open"), [group, "field_name", "later"]).filter("open or undated").select(group, "field_name", "kind").distinct()
    last = several.join(beaten, [group, "field_name", "kind"], "left_anti")
    out = front.filter("n = 1").drop("n").unionByName(last.drop("n"))
    choice = F.struct(F.col("day").isNotNull(), "loaded", -F.col(key))
    return out.groupBy(group, "field_name").agg(F.max_by(F.struct(F.col(key).alias(key), "value"), choice).alias("best")).select(group, "field_name", f"best.{key}", "best.value")


def surviving_records(members: DataFrame, rows: DataFrame, group: str = "group_id", key: str = "row_id") -> DataFrame:
    """One record per group, built from the best value of each field: ``group`` and the four fields, null where no row has a usable value."""
    best = best_values(members, rows, group, key)
    return best.groupBy(group).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS])
