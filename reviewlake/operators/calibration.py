"""Measuring machine screening against a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import canonical_doi, decide, nonblank, parse_score
from reviewlake.operators.journal import HUMAN_SCREEN, MACHINE_SCREEN, entries, latest_human

MENU = (0.85, 0.80, 0.75, 0.70, 0.65)
MENU_GAP = 0.50
BINS, BIN_WIDTH = 20, 0.05


def gold_scores(journal: DataFrame) -> DataFrame:
    """``identity_type, doc, label, score, stratum``: the last human decision of a document, and score and model of its last machine screening line."""
    human = latest_human(journal, HUMAN_SCREEN).select("identity_type", "doc", F.col("decision").alias("label"))
    lines = entries(journal).filter(F.col("stage").isin(*MACHINE_SCREEN))
    last = lines.groupBy("identity_type", "doc").agg(F.max(F.struct("seq", "score", "model")).alias("x"))
    scored = last.select("identity_type", "doc", parse_score("x.score").alias("score"), F.coalesce(nonblank("x.model"), F.lit("(none)")).alias("stratum"))
    return human.join(scored, ["identity_type", "doc"])


def _matrix(positive: Column, predicted: Column, weight: Column) -> list[Column]:
    w = weight.cast("double")
    return [
        F.sum(F.when(positive & predicted, w).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~positive & predicted, w).otherwise(0.0)).alias("fp"),
        F.sum(F.when(positive & ~predicted, w).otherwise(0.0)).alias("fn"),
        F.sum(F.when(~positive & ~predicted, w).otherwise(0.0)).alias("tn"),
    ]


def _safe(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.when(den == 0, F.lit(1.0)).otherwise(den))


def metrics(matrix: DataFrame, digits: int = 4) -> DataFrame:
    """Recall, precision, F1 and kappa of a table with tp, fp, fn, tn; undefined ratios are 0; rounded last."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recall, precision = _safe(tp, tp + fn), _safe(tp, tp + fp)
    n = tp + fp + fn + tn
    po = _safe(tp + tn, n)
    pe = _safe(tp + fp, n) * _safe(tp + fn, n) + _safe(fn + tn, n) * _safe(fp + tn, n)
    return matrix.select(
        *matrix.columns,
        F.round(recall, digits).alias("recall"),
        F.round(precision, digits).alias("precision"),
        F.round(_safe(2 * recall * precision, recall + precision), digits).alias("f1"),
        F.round(_safe(po - pe, 1 - pe), digits).alias("kappa"),
    )


def _routed(gold: DataFrame, include_at: float = 0.75, exclude_at: float = 0.25) -> DataFrame:
    return gold.filter(F.col("label").isin("include", "exclude") & F.col("score").isNotNull()).withColumn("route", decide("score", include_at, exclude_at))


def confusion(gold: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: the confusion matrix and metrics; needs_manual counts as exclude. Kappa is meant for raw counts."""
    return metrics(_routed(gold).agg(*_matrix(F.col("label") == "include", F.col("route") == "include", F.lit(1.0) if weight is None else weight)))


def per_stratum(gold: DataFrame) -> DataFrame:
    """The same per stratum."""
    return metrics(_routed(gold).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *_matrix(F.col("label") == "include", F.col("route") == "include", F.lit(1.0))))


def sampling_weights(gold: DataFrame) -> DataFrame:
    """``stratum, population, sampled, weight``: documents of a stratum for each one with a usable score."""
    out = gold.groupBy("stratum").agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("score").isNotNull()).alias("sampled"))
    return out.select("stratum", "population", "sampled", F.round(_safe(F.col("population").cast("double"), F.col("sampled").cast("double")), 6).alias("weight"))


def plan_weights(gold: DataFrame, plan: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The weights of a sampling plan, ``stratum: (population, sample)``; raises ValueError unless the gold rows fit it exactly.

    Strata are few; one row each comes to the driver.
    """
    bad = sorted(s for s, (big, small) in plan.items() if not 0 < small <= big)
    if bad:
        raise ValueError(f"a population must be at least its sample, and that more than 0: {bad}")
    seen = {r[0]: r[1] for r in gold.groupBy(F.coalesce(F.trim("stratum"), F.lit(""))).agg(F.count(F.lit(1))).collect()}
    errors = ["rows without stratum"] if seen.pop("", 0) else []
    errors += [f"{s} is not in the plan" for s in sorted(set(seen) - set(plan))]
    errors += [f"{s}: {seen.get(s, 0)} rows, planned {n}" for s, (_, n) in sorted(plan.items()) if seen.get(s, 0) != n]
    if errors:
        raise ValueError("; ".join(errors))
    return {s: 1.0 if len(plan) == 1 else big / small for s, (big, small) in plan.items()}


def weighted_confusion(gold: DataFrame) -> DataFrame:
    """The confusion matrix with the sampling weights of the strata, which are few and broadcast only below the size that Spark checks."""
    weights = sampling_weights(gold).select("stratum", "weight")
    return confusion(gold.join(weights, "stratum"), F.col("weight")).select(*[F.round(x, 4).alias(x) for x in ("tp", "fp", "fn", "tn")], "recall", "precision", "f1")


def sensitivity(gold: DataFrame, uncertain: Column) -> DataFrame:
    """One row: least and greatest recall and precision if all uncertain rows were included, or excluded. One pass for both scenarios."""
    base = _routed(gold).withColumn("u", uncertain).withColumn("scenario", F.explode(F.array(F.lit(True), F.lit(False))))
    predicted = F.when(F.col("u"), F.col("scenario")).otherwise(F.col("route") == "include")
    both = metrics(base.groupBy("scenario").agg(*_matrix(F.col("label") == "include", predicted, F.lit(1.0))))
    return both.agg(F.min("recall").alias("recall_min"), F.max("recall").alias("recall_max"), F.min("precision").alias("precision_min"), F.max("precision").alias("precision_max"))


def threshold_menu(gold: DataFrame) -> DataFrame:
    """One row per threshold of the menu, with raw and weighted metrics; the lower one is the binary difference, ambiguous are scores strictly between. The five thresholds are exploded, not joined."""
    weighted = gold.join(sampling_weights(gold).select("stratum", "weight"), "stratum").filter(F.col("label").isin("include", "exclude") & F.col("score").isNotNull())
    rows = weighted.withColumn("ti", F.explode(F.array(*[F.lit(float(t)) for t in MENU]))).withColumn("te", F.col("ti") - F.lit(MENU_GAP))
    s, y = F.col("score"), F.col("label") == "include"
    # Both matrices come from one aggregate.
    heavy = [m.alias(f"w_{n}") for m, n in zip(_matrix(y, s >= F.col("ti"), F.col("weight")), ("tp", "fp", "fn", "tn"))]
    table = rows.groupBy("ti", "te").agg(*_matrix(y, s >= F.col("ti"), F.lit(1.0)), *heavy, F.count(F.lit(1)).alias("n"), F.count_if((s > F.col("te")) & (s < F.col("ti"))).alias("ambiguous"))
    raw = metrics(table).select("ti", "te", "n", "tp", "fp", "fn", "tn", "recall", "precision", "f1", "ambiguous", *[f"w_{n}" for n in ("tp", "fp", "fn", "tn")])
    back = raw.select("ti", "te", "n", "tp", "fp", "fn", "tn", "recall", "precision", "f1", "ambiguous", *[F.struct(*[F.col(f"w_{n}").alias(n) for n in ("tp", "fp", "fn", "tn")]).alias("w")])
    both = metrics(back.select("ti", F.col("w.tp").alias("tp"), F.col("w.fp").alias("fp"), F.col("w.fn").alias("fn"), F.col("w.tn").alias("tn"), F.struct("te", "n", "tp", "fp", "fn", "tn", "recall", "precision", "f1", "ambiguous").alias("raw")))
    return both.select("ti", *[F.col(f"raw.{c}").alias(c) for c in ("te", "n", "tp", "fp", "fn", "tn", "recall", "precision", "f1")], *[both[m].alias(f"weighted_{m}") for m in ("recall", "precision", "f1")], F.round(F.lit(100.0) * F.col("raw.ambiguous") / F.col("raw.n"), 1).alias("ambiguous_pct"))


def score_histogram(gold: DataFrame) -> DataFrame:
    """``bin, n`` of 20 bins of 0.05, empty bins kept. Scores are reduced to bins before the empty ones join."""
    at = F.least(F.floor((F.col("score") + F.lit(1e-12)) / F.lit(BIN_WIDTH)), F.lit(BINS - 1)).cast("int")
    counts = gold.filter("score is not null").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = gold.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def score_summary(gold: DataFrame) -> DataFrame:
    """One row: n, min, max, mean and median of the scores."""
    s = F.col("score")
    return gold.filter("score is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(s), 4).alias("min"), F.round(F.max(s), 4).alias("max"), F.round(F.avg(s), 4).alias("mean"), F.round(F.median(s), 4).alias("median"))


def coverage(gold: DataFrame, least: int = 5, share: float = 0.80) -> DataFrame:
    """One row: evaluated of total, and ``failed`` (too few), ``partial`` or ``complete``."""
    one = gold.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score").isNotNull()).alias("evaluated"))
    ratio = _safe(F.col("evaluated").cast("double"), F.col("total").cast("double"))
    state = F.when((F.col("evaluated") < least) | (ratio < share), "failed").when(F.col("evaluated") < F.col("total"), "partial").otherwise("complete")
    return one.select("total", "evaluated", F.round(ratio, 4).alias("ratio"), state.alias("state"))


def with_metadata(gold: DataFrame, candidates: DataFrame, *fields: str, key: str = "row_id") -> DataFrame:
    """Gold rows (``doi`` among their columns) with fields of the last candidate of the same canonical DOI, null without one."""
    last = candidates.filter(canonical_doi("doi") != "").groupBy(canonical_doi("doi").alias("_doi")).agg(F.max(F.struct(key, *fields)).alias("x"))
    return gold.join(last, canonical_doi(gold["doi"]) == F.col("_doi"), "left").select(*gold.columns, *[F.col(f"x.{f}").alias(f) for f in fields])
