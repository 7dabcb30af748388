"""Reading and writing the files of a review with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE_COLUMNS = ("title", "doi", "source_id", "year", "abstract", "oa_url", "pdf_status", "source", "query", "date")
CANDIDATES = ", ".join(f"{c} string" for c in CANDIDATE_COLUMNS)
JOURNAL = (
    "seq long, ts string, run string, doc string, identity_type string, stage string, decision string, score string, model string, model_served string, actor string, reason string, criterion string, variable string, "
    "doi string, source_id string, oa_url string, merged_ids array<string>, merged_sources array<string>, merged_dois array<string>, merged_id_records array<struct<type:string,value:string,source:string>>"
)
MARKDOWN_LEAST = 500


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A candidate CSV; every column is text, whatever it looks like."""
    return spark.read.schema(CANDIDATES).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_candidates(rows: DataFrame, path: str) -> None:
    """The ten columns of candidates, others left out."""
    rows.select(*CANDIDATE_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines in JSON; absent fields are null, and ``seq`` is in the data because files have no order."""
    return spark.read.schema(JOURNAL).json(path)


def append_journal(lines: DataFrame, path: str) -> None:
    """Journal lines appended, null fields left out."""
    lines.write.mode("append").json(path)


def read_assessments(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All files of a folder of JSON lines, tagged by the stem of their file."""
    return spark.read.schema(schema).json(folder).withColumn("file_stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def read_texts(spark: SparkSession, folder: str, least: int = MARKDOWN_LEAST) -> DataFrame:
    """``path, text`` of the Markdown files of a folder that are longer than ``least``."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.length("text") > least)


def list_dropzone(spark: SparkSession, folder: str) -> DataFrame:
    """``doi, path`` of PDF files named after a DOI; only names are read. The first underscore stands for the slash, further ones are kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return files.select(F.regexp_replace(name, r"^([^_]+)_", "$1/").alias("doi"), "path")


def frozen(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The content of a file whose SHA-256 must be the pinned one."""
    one = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("text"))
    row = one.select("digest").first()
    if row is None or row[0] != digest:
        raise ValueError("frozen input differs from its digest")
    return one
