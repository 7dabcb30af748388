"""Extraction cells: evidence, states, the article by variable matrix, counts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.functions.text import cell_state, exploitable, nonblank, normalize_evidence, strip
from reviewlake.operators.skew import join_hot
from reviewlake.session import cut, parallel

# The variables of the codebook of the test tables.
VARIABLES = ("population", "intervention", "comparator", "outcome", "design", "sample_size", "setting", "follow_up")


#: So many citations of one document are looked for in a text at once.
BATCH = 200


def verifiable_citations(cells: DataFrame, texts: DataFrame, key: str = "text_id") -> DataFrame:
    """``identity_type, doc, citation, verifiable``: whether a text of the document holds the citation word for word.

    Distinct citations meet the texts of their document in batches, so a text is repeated once per batch and not per citation; texts are
    normalised once each, and documents of many texts are spread over slices. Blank citations are not verifiable and left out.
    """
    ident = ["identity_type", "doc"]
    kind = F.coalesce(nonblank("identity_type"), F.lit("doi"))
    quotes = cut(cells.select(kind.alias("identity_type"), nonblank("doc").alias("doc"), normalize_evidence("citation").alias("citation")).filter("doc is not null and citation <> ''").distinct())
    bodies = cut(parallel(texts.select(kind.alias("identity_type"), nonblank("doc").alias("doc"), key, "fulltext"), key).withColumn("body", normalize_evidence("fulltext")).drop("fulltext").filter("doc is not null and body <> ''"))
    asked = quotes.groupBy(*ident).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BATCH).cast("int").alias("m"))
    held = bodies.groupBy(*ident).agg(F.count(F.lit(1)).alias("texts"))
    both = cut(asked.join(held, ident))
    asked_n, held_n = (float(x or 0) for x in both.agg(F.sum("n"), F.sum("texts")).first())
    batched = join_hot(quotes, both, ident, "n", "citation", asked_n).withColumn("batch", F.pmod(F.xxhash64("citation"), "m").cast("int"))
    # A batch holds about ``BATCH`` citations, whatever the document.
    batches = batched.groupBy(*ident, "batch").agg(F.collect_list("citation").alias("quotes"), F.first("texts").alias("texts"))
    wide = join_hot(bodies, both, ident, "texts", key, held_n).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(*ident, "batch", key, "body")
    met = join_hot(wide, batches, [*ident, "batch"], "texts", key, held_n)
    found = met.select(*ident, F.explode(F.filter("quotes", lambda q: F.contains("body", q))).alias("citation")).distinct().withColumn("verifiable", F.lit(True))
    return quotes.join(found, [*ident, "citation"], "left").select(*ident, "citation", F.coalesce("verifiable", F.lit(False)).alias("verifiable"))


def cells_of(extractions: DataFrame) -> DataFrame:
    """The cells with their document, variable and state."""
    return extractions.select(
        F.coalesce(nonblank("identity_type"), F.lit("doi")).alias("identity_type"), nonblank("doc").alias("doc"), nonblank("variable").alias("variable"), strip("valeur").alias("value"), "citation", cell_state("valeur").alias("state")
    )


def extraction_counts(extractions: DataFrame) -> DataFrame:
    """``variable, attempted, cell_values, not_found, api_errors, rejected, blank, articles, articles_with_data``; a null variable is the total."""
    s = F.col("state")
    cells = cells_of(extractions).withColumn("variable", F.coalesce("variable", F.lit("(none)")))
    ident = F.concat_ws("\u0001", "identity_type", "doc")
    return cells.rollup("variable").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(s == "value").alias("cell_values"),
        F.count_if(s == "not_found").alias("not_found"),
        F.count_if(s == "api_error").alias("api_errors"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s == "blank").alias("blank"),
        F.countDistinct(F.when(F.col("doc").isNotNull(), ident)).alias("articles"),
        F.countDistinct(F.when((s == "value") & F.col("doc").isNotNull(), ident)).alias("articles_with_data"),
    )


def values_by_variable(extractions: DataFrame, most: int = 10) -> DataFrame:
    """``variable, ordinal, value``: the first ``most`` distinct values of each variable in order; the ranking is cut before the shuffle."""
    vals = cells_of(extractions).filter(exploitable("value")).select("variable", "value").distinct()
    ranked = vals.withColumn("ordinal", F.row_number().over(W.partitionBy("variable").orderBy("value")))
    return ranked.filter(F.col("ordinal") <= most)


def grid(articles: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Every article with every variable of the fixed codebook."""
    return articles.withColumn("variable", F.explode(F.array(*[F.lit(v) for v in variables])))


def missing_cells(articles: DataFrame, extractions: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """``variable, expected, missing``: how many cells of the grid were never extracted."""
    have = cells_of(extractions).select("identity_type", "doc", "variable").distinct().withColumn("have", F.lit(1))
    met = grid(articles.select("identity_type", "doc").distinct(), variables).join(have, ["identity_type", "doc", "variable"], "left")
    return met.groupBy("variable").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("have").isNull()).alias("missing"))


def wide(extractions: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """One row per article, a column per variable: its least value in order, null without one."""
    cells = cells_of(extractions).filter(exploitable("value") & F.col("doc").isNotNull())
    return cells.groupBy("identity_type", "doc").agg(*[F.min(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables])


def repeated_cells(extractions: DataFrame) -> DataFrame:
    """``identity_type, doc, variable, cells, distinct_values`` of cells extracted more than once."""
    cells = cells_of(extractions).filter("doc is not null and variable is not null")
    return cells.groupBy("identity_type", "doc", "variable").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("value").alias("distinct_values")).filter("cells > 1")


def report_gate(pending: int, cells: int, articles: int, variables: int) -> None:
    """A report needs an empty full-text queue and exactly one cell per article and variable."""
    if pending:
        raise RuntimeError(f"{pending} full-text reviews are pending")
    if cells != articles * variables:
        raise RuntimeError(f"{cells} cells for {articles} articles and {variables} variables")
