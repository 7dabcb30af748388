"""Queries of the llm operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.abuse import rates_by_source, score_documents
from reviewlake.llm.chunks import pieces_of_oversized
from reviewlake.llm.formatting import copy_sets, one_record_each
from reviewlake.llm.linkage import classes, link, link_classes
from reviewlake.llm.packing import pack
from reviewlake.llm.survivor import best_values, surviving_records
from reviewlake.llm.tokens import encode_texts, length_column, vocabulary_file
from reviewlake.llm.visual import consistent_form, find_disguised
from reviewlake.session import cut, table

TEXT_FIELDS = ["title", "abstract"]
PACK_LIMIT = "pack_pass"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Titles and abstracts with a character that is invisible or stands in for another."""
    return find_disguised(table(spark, d, "candidates"), "row_id", TEXT_FIELDS)


def p1_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every title and abstract in one form."""
    return consistent_form(table(spark, d, "candidates"), "row_id", TEXT_FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The row that holds the best value, per group and field."""
    return best_values(table(spark, d, "dup_groups"), table(spark, d, "candidates")).select("group_id", "field_name", "row_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per group."""
    return surviving_records(table(spark, d, "dup_groups"), table(spark, d, "candidates"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every fulltext longer than its limit."""
    return pieces_of_oversized(table(spark, d, "fulltexts"), table(spark, d, "size_limits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The fulltexts that had to be split."""
    return p4_pieces(spark, d).filter("piece_no = 1").select("text_id")


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """Per split fulltext whether its pieces are within the limit, share exactly the overlap, and give the text back."""
    texts, limits = table(spark, d, "fulltexts"), table(spark, d, "size_limits")
    sized = limits.filter("unit = 'characters'").select("limit_name", "max_size", "overlap_size")
    # The pieces of one text, which one row held before.
    whole = p4_pieces(spark, d).groupBy("text_id", "limit_name").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "text"))).alias("ps"))
    met = whole.join(F.broadcast(sized), "limit_name").join(texts.select("text_id", "fulltext"), "text_id")
    step = lambda p, i: F.when(i > 0, (F.col("ps")[i - 1]["end"] - p["start"]) == F.col("overlap_size")).otherwise(p["start"] == 0)
    parts = F.transform("ps", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.substring(p["text"], F.col("overlap_size").cast("int") + 1, F.length(p["text"]))))
    within = F.forall("ps", lambda p: F.length(p["text"]) <= F.col("max_size"))
    return met.select("text_id", within.alias("within"), F.forall(F.transform("ps", step), lambda x: x).alias("overlap_exact"), (F.array_join(parts, "") == F.col("fulltext")).alias("rebuilt"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copy with the first row of its set."""
    return copy_sets(table(spark, d, "candidates"), "row_id").filter("first <> row_id").select(F.col("first").alias("first_row_id"), F.col("row_id").alias("copy_row_id"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per set with the number of its copies."""
    return one_record_each(table(spark, d, "candidates"), "row_id")


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cand = table(spark, d, "candidates").select(F.col("row_id").alias("id"), "title", "authors", "year", F.col("source_id").alias("tail"), "source")
    items = table(spark, d, "library_items").select(
        F.col("item_id").alias("id"), F.col("heading").alias("title"), F.col("creators").alias("authors"), F.col("issued").alias("year"), F.col("accession_tail").alias("tail"), F.col("via").alias("source")
    )
    return cand, items


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal records that describe the same work, with the sizes of the classes and a confidence."""
    pairs, _, _ = link_classes(*_p7(spark, d))
    name = lambda side: F.concat_ws("-", F.hex(f"{side}_cls.p1"), F.hex(f"{side}_cls.p2"))
    return pairs.select(name("left").alias("candidate_class"), name("right").alias("item_class"), F.col("left_n").alias("candidates"), F.col("right_n").alias("items"), "confidence")


def p7_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of every candidate and item, as p7_links names it."""
    sides = [classes(rows)[0].select(F.lit(side).alias("side"), "id", F.concat_ws("-", F.hex("cls.p1"), F.hex("cls.p2")).alias("class")) for side, rows in zip(("candidate", "item"), _p7(spark, d))]
    return sides[0].unionByName(sides[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with every item that describes the same work."""
    return link(*_p7(spark, d)).select(F.col("left_id").alias("row_id"), F.col("right_id").alias("item_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, d, "documents"))


def _capacity(spark: SparkSession, d: str) -> int:
    # size_limits is a fixed table of a few rows.
    return table(spark, d, "size_limits").filter((F.col("limit_name") == PACK_LIMIT) & (F.col("unit") == "tokens")).agg(F.min("max_size")).first()[0]


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of an oversized one, in its container."""
    capacity = _capacity(spark, d)
    sized = table(spark, d, "documents").select("doc_id", length_column(F.col("text"), vocabulary_file()).alias("tokens"))
    return pack(sized, capacity, "doc_id", "tokens")


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents packed, documents whose parts do not add up, containers over the capacity, and documents split without need."""
    capacity = _capacity(spark, d)
    sized = table(spark, d, "documents").select("doc_id", length_column(F.col("text"), vocabulary_file()).alias("tokens"))
    packed = cut(pack(sized, capacity, "doc_id", "tokens"))
    per_doc = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts")).join(sized, "doc_id")
    docs = per_doc.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("size") != F.coalesce("tokens", F.lit(0))).alias("wrong_size"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= capacity)).alias("split_without_need"))
    over = packed.groupBy("container").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("overfull"))
    # Each side is one row.
    return docs.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document and what it is for."""
    return score_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a passage that is abusive, hateful or sexual."""
    return p10_scores(spark, d).filter("score >= 0.5").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of such documents per source."""
    return rates_by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_normalized, p3_found, p3_records, p4_found, p4_pieces, p4_check, p6_found, p6_records, p7_found, p7_links, p7_members, p8_ids, p9_packed, p9_check, p10_found, p10_scores, p10_rates)}
_OVERSIZED = "FROM fulltexts f JOIN size_limits l ON f.limit_name = l.limit_name AND l.unit = 'characters' WHERE length(f.fulltext) > l.max_size"
ORACLE_SQL = {
    "p4_check": f"SELECT f.text_id, TRUE AS within, TRUE AS overlap_exact, TRUE AS rebuilt {_OVERSIZED}",
    "p9_check": "SELECT count(*) AS documents, 0 AS wrong_size, 0 AS split_without_need, 0 AS overfull FROM documents",
    "p4_found": f"SELECT f.text_id {_OVERSIZED}",
}
