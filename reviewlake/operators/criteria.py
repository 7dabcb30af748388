"""Criterion assessments: validation, coherence, routing, acceptance, and analytics over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.functions.text import canonical_doi, nonblank, strip

STATUSES = ("met", "not_met", "unclear", "not_reported")
# The criteria by their short names, and the coherence rules as (if, is, then, and what that must or must not be, and the text of the error).
INCLUSION, EXCLUSION = ("I1", "I2", "I3", "I4", "I5"), ("E1", "E2", "E3", "E4", "E5", "E6")
COHERENCE_RULES = (
    ("E1_NO_ACTIONABLE_TECHNIQUE", "met", "I1_PROMPT_TECHNIQUE", ("not_met", "not_reported"), True, "E1 requires I1_PROMPT_TECHNIQUE to be not_met or not_reported"),
    ("E3_BENCHMARK_ONLY", "met", "I2_REPRODUCIBLE", ("not_met", "not_reported"), True, "E3 requires I2_REPRODUCIBLE to be not_met or not_reported"),
    ("E4_APPLICATION_WITHOUT_PROMPT_DETAIL", "met", "I2_REPRODUCIBLE", ("not_met", "not_reported"), True, "E4 requires I2_REPRODUCIBLE to be not_met or not_reported"),
    ("E2_MODEL_TRAINING_ONLY", "met", "I4_PRACTITIONER", ("met",), False, "E2 requires I4_PRACTITIONER to be different from met"),
    ("I4_PRACTITIONER", "met", "I1_PROMPT_TECHNIQUE", ("not_met",), False, "I4 requires I1_PROMPT_TECHNIQUE to be different from not_met"),
)
ENGLISH = ("en", "eng", "english")
# Error classes in order of precedence, by version: (any of these substrings, class).
_GROUNDING = (("quote", "evidence"), "quote/evidence grounding")
_TAIL = ((("schema",), "schema"), (("order/coverage",), "criterion order/coverage"), (("status is invalid",), "status"), (("fields are invalid",), "field shape"), (("reason",), "reason"))
TAXONOMIES: dict[str, tuple[tuple[tuple[str, ...], str], ...]] = {
    "v1": (
        (("requires evidence",), "requires evidence"), (("duplicate json key",), "duplicate JSON key"), (("quote",), "quote/evidence grounding"), (("coherence", "requires i"), "coherence"), (("schema",), "schema"), (("order/coverage",), "criterion order/coverage"),
        (("fields are invalid",), "field shape"), (("status is invalid",), "status"), (("evidence must", "evidence forbids"), "evidence shape"), (("reason",), "reason"),
    ),
    "v2": ((("requires evidence",), "requires evidence"), (("coherence", "requires i"), "coherence"), _GROUNDING, *_TAIL),
    "v3": ((("quote found in ",), "source-label mismatch"), (("requires evidence",), "requires evidence"), (("coherence", "requires i"), "coherence"), _GROUNDING, *_TAIL),
    "terminal": ((("requires evidence",), "requires-evidence"), (("quote found in ",), "source-label mismatch"), (("quote", "evidence"), "grounding"), (("coherence", "requires i"), "coherence"), (("technical:",), "technical"), (("schema",), "schema")),
}
OTHER_ERROR = "other validation"


# ---- one assessment ----------------------------------------------------------------------------------------------


def status_of(criteria: Column, ident: str) -> Column:
    """The status of the first item of a criterion; null without one."""
    return F.try_element_at(F.filter(criteria, lambda x: x["id"] == ident), F.lit(1))["status"]


def coherence_errors(criteria: Column) -> Column:
    """The broken implications between criteria, only where all statuses are valid and both items are there."""
    valid = F.forall(criteria, lambda x: x["status"].isin(*STATUSES))
    out = []
    for a, is_, b, others, must, what in COHERENCE_RULES:
        sa, sb = status_of(criteria, a), status_of(criteria, b)
        bad = (sa == is_) & (~sb.isin(*others) if must else sb.isin(*others))
        out.append(F.when(valid & sa.isNotNull() & sb.isNotNull() & bad, F.lit(what)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def language_status(language: Column) -> Column:
    """Whether the language is English; not reported without one."""
    v = F.lower(strip(F.coalesce(language, F.lit(""))))
    return F.when(v == "", "not_reported").when(v.isin(*ENGLISH), "met").otherwise("not_met")


def recency_status(year: Column, after: int = 2020) -> Column:
    """Whether a year of four digits lies after ``after``; not reported without one."""
    v = strip(F.coalesce(year, F.lit("")))
    digits = F.when(v.rlike(r"^\d{4}$"), v).otherwise("0").cast("int")
    return F.when(~v.rlike(r"^\d{4}$"), "not_reported").when(digits > after, "met").otherwise("not_met")


def hard_fails(criteria: Column) -> Column:
    """The criteria that exclude: an inclusion not met or an exclusion met, in their order."""
    bad = F.filter(criteria, lambda x: (x["id"].startswith("I") & (x["status"] == "not_met")) | (x["id"].startswith("E") & (x["status"] == "met")))
    return F.transform(bad, lambda x: x["id"])


def route(criteria: Column, valid: Column, allowlist: tuple[str, ...] = ()) -> Column:
    """Exclusion by an allowed hard fail, else a human for any hard fail, unclear status or unreported inclusion, else inclusion."""
    fails = hard_fails(criteria)
    allowed = F.arrays_overlap(fails, F.array(*[F.lit(a) for a in allowlist])) if allowlist else F.lit(False)
    unclear = F.exists(criteria, lambda x: x["status"] == "unclear")
    unreported = F.exists(criteria, lambda x: x["id"].startswith("I") & (x["status"] == "not_reported"))
    return F.when(~valid, "invalid_assessment").when(allowed, "exclude").when((F.size(fails) > 0) | unclear | unreported, "needs_manual").otherwise("include")


def accepted(category: Column, complete: Column, errors: Column, fails: Column, route_: Column, expected: Column) -> Column:
    """The acceptance oracle by category; null for coverage cases and unknown categories."""
    broken = ~complete | (F.size(errors) > 0)
    return (
        F.when(category.startswith("state_coverage"), F.lit(None).cast("boolean"))
        .when(category == "holdout_exclude", ~F.exists(errors, lambda e: e.startswith("coherence")) & (route_ != "include"))
        .when(category.isin("known_reasoner_false_positive", "known_chat_low_score_true_positive", "holdout_include") & broken, F.lit(False))
        .when(category == "known_reasoner_false_positive", F.arrays_overlap(fails, expected))
        .when(category == "known_chat_low_score_true_positive", (F.size(fails) == 0) & route_.isin("include", "needs_manual"))
        .when(category == "holdout_include", F.size(fails) == 0)
    )


def error_class(error: Column, version: str = "v3") -> Column:
    """The class of an error: the first rule of the version that matches, else another validation error."""
    low = F.lower(error)
    out = F.lit(OTHER_ERROR)
    for needles, name in reversed(TAXONOMIES[version]):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(low, F.lit(n))
        if name == "source-label mismatch":
            hit = hit & F.contains(low, F.lit("declared "))
        out = F.when(hit, name).otherwise(out)
    return out


# ---- tables of assessments -------------------------------------------------------------------------------------------


def journal_assessments(journal: DataFrame) -> DataFrame:
    """Assessment rows from the journal: a case is a document, a replicate the letter of a run, a bloc its year.

    ``identity_type, case_id, bloc, replicate, hard_fails, statuses, errors, valid, human_label, route``. The criterion of an excluding line is
    a hard fail; lines with a criterion and another decision report it unclear or met; failed calls are technical errors.
    """
    run = F.regexp_extract("run", r"^run-(\d{4})-\d{2}-([a-z])$", 0)
    lines = journal.select(
        "seq",
        F.coalesce(nonblank("identity_type"), F.lit("doi")).alias("identity_type"),
        nonblank("doc").alias("case_id"),
        F.regexp_extract("run", r"^run-(\d{4})-\d{2}-([a-z])$", 1).alias("bloc"),
        F.regexp_extract("run", r"^run-(\d{4})-\d{2}-([a-z])$", 2).alias("replicate"),
        "stage",
        "decision",
        nonblank("criterion").alias("criterion"),
        nonblank("reason").alias("reason"),
    ).filter((run != "") & F.col("case_id").isNotNull())
    human = F.col("stage").isin("human_review", "human_review_fulltext") & F.col("decision").isin("include", "exclude")
    labels = lines.filter(human).groupBy("identity_type", "case_id").agg(F.max(F.struct("seq", "decision")).alias("x")).select("identity_type", "case_id", F.col("x.decision").alias("human_label"))
    fails = F.when((F.col("decision") == "exclude") & F.col("criterion").isNotNull(), F.col("criterion"))
    error = F.when(F.col("reason") == "quote not found", F.lit("quote not found in source")).when(F.col("decision") == "rejected_citation", F.lit("evidence requires evidence")).when(F.col("decision") == "api_error", F.lit("technical: call failed"))
    machine = lines.filter(F.col("stage").isin("screen_title_abstract", "screen_fulltext", "extract"))
    rows = machine.groupBy("identity_type", "case_id", "bloc", "replicate").agg(
        F.sort_array(F.collect_set(fails)).alias("hard_fails"), F.sort_array(F.collect_set(error)).alias("errors"), F.count_if(F.col("decision") == "needs_manual").alias("unclear"), F.count_if(F.col("decision") == "include").alias("inc")
    )
    rows = rows.join(labels, ["identity_type", "case_id"], "left")
    valid = F.size("errors") == 0
    routed = F.when(~valid, "invalid_assessment").when((F.size("hard_fails") > 0) | (F.col("unclear") > 0), "needs_manual").otherwise("include")
    return rows.select("identity_type", "case_id", "bloc", "replicate", "hard_fails", "errors", valid.alias("valid"), F.coalesce("human_label", F.lit("(missing)")).alias("human_label"), routed.alias("route"))


def route_table(rows: DataFrame) -> DataFrame:
    """``human_label, include_n, needs_manual_n, invalid_n, total``; a null label is all rows."""
    r = F.col("route")
    return rows.rollup("human_label").agg(F.count_if(r == "include").alias("include_n"), F.count_if(r == "needs_manual").alias("needs_manual_n"), F.count_if(r == "invalid_assessment").alias("invalid_n"), F.count(F.lit(1)).alias("total"))


def hard_fail_table(rows: DataFrame) -> DataFrame:
    """``criterion, human_label, valid, n``: hard fails by label and validity."""
    return rows.select(F.explode("hard_fails").alias("criterion"), "human_label", "valid").groupBy("criterion", "human_label", "valid").agg(F.count(F.lit(1)).alias("n"))


def invalid_rates(rows: DataFrame) -> DataFrame:
    """``bloc, replicate, rows_n, invalid_n, rate`` per bloc and replicate, and in total with both null."""
    both = rows.groupingSets([[F.col("bloc"), F.col("replicate")], []], F.col("bloc"), F.col("replicate"))
    out = both.agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(~F.col("valid")).alias("invalid_n"))
    return out.select("bloc", "replicate", "rows_n", "invalid_n", F.round(F.col("invalid_n") / F.col("rows_n"), 6).alias("rate"))


def stratification(rows: DataFrame, field: str = "bloc") -> DataFrame:
    """Records, labels, validity and routes by the values of a field, missing ones together."""
    key = F.coalesce(nonblank(field), F.lit("(missing)"))
    r, lab = F.col("route"), F.col("human_label")
    return rows.groupBy(key.alias("stratum")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(lab == "include").alias("include_n"), F.count_if(lab == "exclude").alias("exclude_n"), F.count_if("valid").alias("valid_n"), F.count_if(~F.col("valid")).alias("invalid_n"), F.count_if(r == "needs_manual").alias("manual_n")
    )


def error_taxonomy(rows: DataFrame, version: str = "v3") -> DataFrame:
    """``error_class, n``: errors by class."""
    return rows.select(F.explode("errors").alias("e")).groupBy(error_class(F.col("e"), version).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def candidate_rules(rows: DataFrame, least: int = 3, candidates: tuple[str, ...] = EXCLUSION) -> DataFrame:
    """``criterion, include_hits, exclude_cases, verdict``: disqualified by any valid hit on an included case, qualified by hits on ``least`` distinct excluded cases."""
    hits = rows.filter("valid").select(F.explode("hard_fails").alias("criterion"), "human_label", F.concat_ws("\u0001", "identity_type", "case_id").alias("case"))
    stats = hits.groupBy("criterion").agg(F.count_if(F.col("human_label") == "include").alias("include_hits"), F.countDistinct(F.when(F.col("human_label") == "exclude", F.col("case"))).alias("exclude_cases"))
    every = rows.sparkSession.createDataFrame([(x,) for x in candidates], "criterion string")
    out = every.join(stats, "criterion", "left").fillna(0, ["include_hits", "exclude_cases"])
    verdict = F.when(F.col("include_hits") > 0, "disqualified").when(F.col("exclude_cases") < least, "not_qualified").otherwise("qualified")
    return out.select("criterion", "include_hits", "exclude_cases", verdict.alias("verdict"))


def simulate_allowlist(rows: DataFrame, allowlist: tuple[str, ...]) -> DataFrame:
    """One row: excluded and included cases that the allowlist would hit, and the automation rate over valid exclusions."""
    hit = F.arrays_overlap("hard_fails", F.array(*[F.lit(a) for a in allowlist]))
    one = rows.filter("valid").agg(F.count_if(F.col("human_label") == "exclude").alias("exclude_rows"), F.count_if((F.col("human_label") == "exclude") & hit).alias("exclude_hits"), F.count_if((F.col("human_label") == "include") & hit).alias("include_hits"))
    rate = F.when(F.col("exclude_rows") > 0, F.col("exclude_hits") / F.greatest(F.lit(1), F.col("exclude_rows"))).otherwise(0.0)
    return one.select("exclude_rows", "exclude_hits", "include_hits", F.round(rate, 6).alias("automation_rate"))


def pair_summaries(rows: DataFrame, replicates: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Cases with their replicates put together: complete, valid (complete and all valid), observed (union) and, of valid ones, reproduced (intersection) hard fails.

    ``identity_type, case_id, bloc, complete, valid, human_label, observed, reproduced, identical``.
    """
    mine = rows.filter(F.col("replicate").isin(*replicates))
    # One row per replicate comes in, so the lists have at most as many entries as there are replicates.
    one = mine.groupBy("identity_type", "case_id", "bloc").agg(F.array_sort(F.collect_list(F.struct("replicate", "hard_fails"))).alias("rs"), F.bool_and("valid").alias("valid"), F.max("human_label").alias("human_label"))
    sets = F.transform("rs", lambda r: F.array_sort(r["hard_fails"]))
    observed = F.array_sort(F.array_distinct(F.flatten(sets)))
    complete = F.size("rs") == len(replicates)
    valid = complete & F.col("valid")
    reproduced = F.when(valid, F.array_sort(F.aggregate(sets, observed, lambda acc, x: F.array_intersect(acc, x)))).otherwise(F.array().cast("array<string>"))
    return one.select("identity_type", "case_id", "bloc", complete.alias("complete"), valid.alias("valid"), "human_label", observed.alias("observed"), reproduced.alias("reproduced"), (complete & (F.size(F.array_distinct(sets)) == 1)).alias("identical"))


def stability(pairs: DataFrame) -> DataFrame:
    """``bloc, pairs_n, identical_n, rate`` over complete valid pairs, in total with a null bloc."""
    good = pairs.filter("complete and valid")
    out = good.rollup("bloc").agg(F.count(F.lit(1)).alias("pairs_n"), F.count_if("identical").alias("identical_n"))
    return out.select("bloc", "pairs_n", "identical_n", F.round(F.col("identical_n") / F.col("pairs_n"), 6).alias("rate"))


def reproduced_table(pairs: DataFrame) -> DataFrame:
    """``criterion, human_label, n`` of reproduced hard fails."""
    return pairs.select(F.explode("reproduced").alias("criterion"), "human_label").groupBy("criterion", "human_label").agg(F.count(F.lit(1)).alias("n"))


def unsafe_includes(pairs: DataFrame) -> DataFrame:
    """Included cases with a reproduced hard fail."""
    return pairs.filter((F.col("human_label") == "include") & (F.size("reproduced") > 0)).select("identity_type", "case_id", "bloc", "reproduced")


def terminal_rules(pairs: DataFrame, least: int = 3) -> DataFrame:
    """The candidate rules on reproduced hard fails of complete pairs only."""
    rows = pairs.filter("complete").select("identity_type", "case_id", "valid", "human_label", F.col("reproduced").alias("hard_fails"))
    return candidate_rules(rows, least)


def assisted_policy(pairs: DataFrame, allowlist: tuple[str, ...] = ("E1",)) -> DataFrame:
    """``reason, n``: why each case goes to a human, or is proposed; the first reason in order counts."""
    allow = F.array(*[F.lit(a) for a in allowlist])
    obs, rep, lab = F.col("observed"), F.col("reproduced"), F.col("human_label")
    reason = (
        F.when(~F.col("complete"), "incomplete_pair")
        .when(~F.col("valid"), "invalid_pair")
        .when((lab == "include") & F.arrays_overlap(rep, allow), "include_violation")
        .when(lab == "(missing)", "label_missing")
        .when(F.size(obs) == 0, "no_hard_fail")
        .when(~F.arrays_overlap(obs, allow), "not_allowlisted")
        .when(~F.arrays_overlap(rep, allow), "not_reproduced")
        .when(F.size(F.array_except(obs, allow)) > 0, "other_hard_fail")
        .otherwise("proposal")
    )
    return pairs.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def hash_sample(rows: DataFrame, per: str, value: Column, ties: str, most: int) -> DataFrame:
    """The first ``most`` rows of each ``per`` in the order of the SHA-256 of a value, with their ``rank``; the cut comes before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(per).orderBy(F.sha2(value, 256), ties)))
    return ranked.filter(F.col("rank") <= most)


def fresh_candidates(candidates: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """``doi, row_id, title``: the first rows of DOIs that are usable and not in ``known`` (a column ``doi``), in hash order, at most ``most``."""
    doi = canonical_doi("doi")
    usable = candidates.filter((doi != "") & nonblank("title").isNotNull() & nonblank("abstract").isNotNull()).select(doi.alias("doi"), "row_id", "title")
    first = usable.groupBy("doi").agg(F.min(F.struct("row_id", "title")).alias("x")).select("doi", "x.row_id", "x.title")
    fresh = first.join(known.select(canonical_doi("doi").alias("doi")).distinct(), "doi", "left_anti")
    return fresh.orderBy(F.sha2("doi", 256)).limit(most)


def corpus_delta(broad: DataFrame, narrow: DataFrame, key: str) -> DataFrame:
    """``broad_n, narrow_n, delta_n, outside_n``: what the broad corpus has beyond the narrow one, and what breaks its containment."""
    b, n = broad.select(key).distinct().withColumn("b", F.lit(1)), narrow.select(key).distinct().withColumn("n", F.lit(1))
    met = b.join(n, key, "full")
    return met.agg(F.count("b").alias("broad_n"), F.count("n").alias("narrow_n"), F.count_if(F.col("n").isNull()).alias("delta_n"), F.count_if(F.col("b").isNull()).alias("outside_n"))


def wilson(hits: int, n: int, z: float = 1.96) -> tuple[float, float]:
    """The Wilson interval of a share."""
    if n == 0:
        return 0.0, 1.0
    p, d = hits / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5
    return (mid - half) / d, (mid + half) / d
