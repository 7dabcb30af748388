"""Queries of the general training-data operators (packed fields, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators.orphans import journal_orphans, orphan_report
from reviewlake.operators.packed import segment_values
from reviewlake.session import table

PACKED_FIELDS = ["authors", "subjects"]


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """One row per candidate, field and value."""
    return segment_values(table(spark, d, "candidates"), "row_id", PACKED_FIELDS).select("row_id", "field_name", "pos", "item")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of fields that hold two or more."""
    found = segment_values(table(spark, d, "candidates"), "row_id", PACKED_FIELDS)
    return found.filter(F.col("n_items") >= 2).select("row_id", "field_name", "pos", "item")


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, d, t) for t in ("decisions", "candidates", "withdrawn"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Journal lines whose record is not, no longer or not yet there."""
    return journal_orphans(*_p5(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan lines per table and month."""
    return orphan_report(*_p5(spark, d))


_KEY = """CASE WHEN {k} = 'doi' THEN regexp_replace(regexp_replace(lower(regexp_replace({v}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')),
  '^((https?://)?([\\w.-]*\\bdoi\\b[\\w.-]*)/+|doi:?[\\s\\p{{Z}}]*)+(10\\.|[\\s\\p{{Z}}]*$)', '\\4'), '[.\\s\\p{{Z}}]+$', '')
  ELSE regexp_replace({v}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') END"""
_KIND = "coalesce(nullif(regexp_replace({t}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), ''), 'doi')"

P5_SQL = f"""
WITH parents AS (
  SELECT kind, key, min(day) AS first_day FROM (
    SELECT kind, {_KEY.format(k="kind", v="value")} AS key, day FROM (
      SELECT 'doi' AS kind, doi AS value, try_cast(substr(trim(date), 1, 10) AS DATE) AS day FROM candidates
      UNION ALL SELECT 'source_id', source_id, try_cast(substr(trim(date), 1, 10) AS DATE) FROM candidates
      UNION ALL SELECT 'oa_url', oa_url, try_cast(substr(trim(date), 1, 10) AS DATE) FROM candidates))
  WHERE key <> '' GROUP BY kind, key),
gone AS (SELECT DISTINCT kind, {_KEY.format(k="kind", v="doc")} AS key FROM (SELECT doc, {_KIND.format(t="identity_type")} AS kind FROM withdrawn)),
refs AS (
  SELECT seq, kind, {_KEY.format(k="kind", v="doc")} AS key, CAST(timezone('UTC', try_cast(ts AS TIMESTAMPTZ)) AS DATE) AS day
  FROM (SELECT seq, doc, ts, {_KIND.format(t="identity_type")} AS kind FROM decisions)
  WHERE regexp_replace(doc, '[\\s\\p{{Z}}]', '', 'g') <> ''),
judged AS (
  SELECT refs.seq, refs.day, CASE WHEN parents.first_day > refs.day THEN 'late' WHEN parents.first_day IS NOT NULL THEN NULL
    WHEN gone.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs LEFT JOIN parents ON refs.kind = parents.kind AND refs.key = parents.key AND refs.key <> ''
  LEFT JOIN gone ON refs.kind = gone.kind AND refs.key = gone.key AND refs.key <> '')
"""

QUERIES = {"p2_values": p2_values, "p2_found": p2_found, "p5_found": p5_found, "p5_report": p5_report}
ORACLE_SQL = {
    "p5_found": P5_SQL + "SELECT seq, kind FROM judged WHERE kind IS NOT NULL",
    "p5_report": P5_SQL + "SELECT 'decisions' AS table_name, strftime(day, '%Y-%m') AS period, kind, count(*) AS orphan_lines FROM judged WHERE kind IS NOT NULL GROUP BY 2, 3",
}
