"""Assessments of cases against criteria, from the served text to result rows, and the evaluation of runs.

An assessment comes as JSON text; faults of every kind must be seen, so it is parsed as text and never forced into a
schema first. What follows from the statuses (coherence, hard fails, route, acceptance) is column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.lazy import arrow_udf
from reviewlake.functions.text import nonblank, sentence_records
from reviewlake.functions.udfs import spaced_text, span_text
from reviewlake.operators.criteria import STATUSES, accepted, coherence_errors, hard_fails, language_status, recency_status, route

# The criteria in order; those from metadata; schemas of assessments.
CRITERIA = (
    "I1_PROMPT_TECHNIQUE", "I2_REPRODUCIBLE", "I3_LLM_TARGET", "I4_PRACTITIONER", "I5_ENGLISH", "I6_AFTER_2020", "E1_NO_ACTIONABLE_TECHNIQUE", "E2_MODEL_TRAINING_ONLY", "E3_BENCHMARK_ONLY",
    "E4_APPLICATION_WITHOUT_PROMPT_DETAIL", "E5_NON_PRIMARY_WITHOUT_ISOLABLE_TECHNIQUE",
)
METADATA = ("I5_ENGLISH", "I6_AFTER_2020")
MODEL_CRITERIA = tuple(c for c in CRITERIA if c not in METADATA)
SCHEMA, SCHEMA_V0 = "criterion_assessment.v1-microtest", "criterion_assessment.v0-microtest"


class AssessmentError(ValueError):
    """A served text that holds no assessment."""


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise AssessmentError(f"duplicate JSON key: {k}")
        out[k] = v
    return out


def parse_content(content: str | None) -> dict:
    """The object in a served text; raises :class:`AssessmentError` for an empty text, no JSON, a repeated key and no object."""
    if not content:
        raise AssessmentError("response content is empty")
    try:
        parsed = json.loads(content, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        raise AssessmentError(f"invalid JSON: {e.msg}") from e
    if not isinstance(parsed, dict):
        raise AssessmentError("assessment JSON must be an object")
    return parsed


def served_content(response: str | None) -> str:
    """The content of the first choice of a chat answer in JSON; raises :class:`AssessmentError` where there is none or it was cut."""
    try:
        choices = json.loads(response or "{}").get("choices") or []
    except (ValueError, AttributeError):
        choices = []
    if not choices:
        raise AssessmentError("response has no choices")
    if choices[0].get("finish_reason") == "length":
        raise AssessmentError("response truncated with finish_reason=length")
    content = (choices[0].get("message") or {}).get("content", "")
    if not isinstance(content, str) or not content:
        raise AssessmentError("response content is empty")
    return content


def item_errors(at: str, item: object, sources: dict[str, str], matcher: Callable[[str], str], mislabels: bool) -> list[str]:
    """The errors of one item of an assessment, in order."""
    if not isinstance(item, dict):
        return [f"{at} must be an object"]
    errors = [] if set(item) == {"id", "status", "evidence", "reason"} else [f"{at} fields are invalid"]
    status, evidence = item.get("status"), item.get("evidence")
    if status not in STATUSES:
        errors.append(f"{at}.status is invalid: {status!r}")
    if not isinstance(evidence, list):
        return [*errors, f"{at}.evidence must be an array"]
    if status == "not_reported" and evidence:
        errors.append(f"{at}: not_reported forbids evidence")
    if status in ("met", "not_met", "unclear") and not evidence:
        errors.append(f"{at}: {status} requires evidence")
    errors += [e for k, piece in enumerate(evidence) if (e := _evidence_error(f"{at}.evidence[{k}]", piece, sources, matcher, mislabels))]
    reason = item.get("reason")
    return errors if isinstance(reason, str) and reason.strip() else [*errors, f"{at}.reason is empty"]


def _evidence_error(at: str, piece: object, sources: dict[str, str], matcher: Callable[[str], str], mislabels: bool) -> str | None:
    if not isinstance(piece, dict) or set(piece) != {"source", "quote"}:
        return f"{at} fields are invalid"
    source, quote = piece["source"], piece["quote"]
    if not isinstance(source, str) or source not in sources:
        return f"{at}.source is invalid: {source!r}"
    if not isinstance(quote, str) or not quote.strip():
        return f"{at}.quote is empty"
    if "..." in quote or "…" in quote:
        return f"{at}: quote contains ellipsis"
    wanted = matcher(quote)
    if not wanted:
        return f"{at}.quote is empty after normalization"
    if wanted in matcher(sources[source]):
        return None
    other = next((s for s, t in sources.items() if s != source and wanted in matcher(t)), None) if mislabels else None
    return f"{at}.quote found in {other}, declared {source}" if other else f"{at}.quote not found in {source}"


def assessment_errors(assessment: object, sources: dict[str, str], ids: tuple[str, ...] = MODEL_CRITERIA, schema: str = SCHEMA, matcher: Callable[[str], str] = span_text, mislabels: bool = False) -> list[str]:
    """The errors of an assessment against the sources of its case, in order. ``mislabels`` names the source in which a quote stands instead."""
    if not isinstance(assessment, dict):
        return ["assessment must be an object"]
    errors = [] if set(assessment) == {"schema", "criteria"} else ["top-level fields must be exactly schema and criteria"]
    if assessment.get("schema") != schema:
        errors.append(f"schema must be {schema}")
    items = assessment.get("criteria")
    if not isinstance(items, list):
        return [*errors, "criteria must be an array"]
    found = [x.get("id") if isinstance(x, dict) else None for x in items]
    if found != list(ids):
        errors.append(f"criterion order/coverage mismatch: {found!r}")
    return errors + [e for k, x in enumerate(items) for e in item_errors(f"criteria[{k}]", x, sources, matcher, mislabels)]


def replay_valid(content: str | None, sources: dict[str, str], ids: tuple[str, ...], matcher: Callable[[str], str]) -> bool:
    """Whether an assessment of the oldest schema holds under a matcher: whole title and abstract as sources, ellipses allowed."""
    try:
        assessment = parse_content(content)
    except AssessmentError:
        return False
    errors = assessment_errors(assessment, sources, ids, SCHEMA_V0, matcher)
    items = assessment.get("criteria") if isinstance(assessment.get("criteria"), list) else []
    # Ellipses and quotes that normalise to nothing are no faults here; such quotes must still be found.
    allowed = {f"criteria[{k}].evidence[{j}]" for k, x in enumerate(items) if isinstance(x, dict) for j, p in enumerate(x.get("evidence") or []) if isinstance(p, dict) and isinstance(p.get("quote"), str) and matcher(p["quote"]) in matcher(sources.get(p.get("source"), ""))}
    return all(e.split(":")[0].removesuffix(".quote is empty after normalization") in allowed and ("ellipsis" in e or "after normalization" in e) for e in errors)


def aligned(assessment: dict, ids: tuple[str, ...] = MODEL_CRITERIA) -> list[dict]:
    """The items of an assessment in the order of the criteria; of several items of one id the last counts."""
    items = assessment.get("criteria") if isinstance(assessment.get("criteria"), list) else []
    by_id = {x["id"]: x for x in items if isinstance(x, dict) and isinstance(x.get("id"), str)}
    return [{"id": i, "status": str(by_id[i].get("status"))} for i in ids if i in by_id]


_ITEMS = "array<struct<id:string,status:string>>"


def assess(mislabels: bool = False) -> Callable[..., Column]:
    """``errors, items`` of the columns content, title and sentences (an array of ``source, text``)."""

    @arrow_udf(f"struct<errors:array<string>,items:{_ITEMS}>")
    def run(content: pd.Series, title: pd.Series, sentences: pd.Series) -> pd.DataFrame:
        out = []
        for c, t, ss in zip(content, title, sentences):
            sources = {"T": t or ""} | {s["source"]: s["text"] or "" for s in (ss if ss is not None else ())}
            try:
                parsed = parse_content(c)
                out.append((assessment_errors(parsed, sources, mislabels=mislabels), aligned(parsed)))
            except AssessmentError as e:
                out.append(([str(e)], []))
        return pd.DataFrame(out, columns=["errors", "items"])

    return run


def call_slots(cases: DataFrame, replicates: int = 2) -> DataFrame:
    """Every case once per replicate, from 1."""
    return cases.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))


def assessment_results(served: DataFrame, mislabels: bool = False) -> DataFrame:
    """Result rows of served assessments: ``case_id, replicate, ...`` with ``validation_errors, coherence_errors, hard_fails, complete, route, valid, accepted, full_assessment``.

    ``served`` has ``case_id, replicate, content, title, abstract, language, publication_year, category, expected``. Items of the model are
    aligned with the criteria and those from metadata added; hard fails count only where all criteria are there.
    """
    got = served.withColumn("a", assess(mislabels)("content", "title", sentence_records(F.coalesce("abstract", F.lit("")))))
    metadata = F.array(*[F.struct(F.lit(i).alias("id"), s.alias("status")) for i, s in (("I5_ENGLISH", language_status(F.col("language"))), ("I6_AFTER_2020", recency_status(F.col("publication_year"))))])
    every = F.concat(F.col("a.items"), metadata)
    ordered = F.flatten(F.transform(F.array(*[F.lit(c) for c in CRITERIA]), lambda c: F.filter(every, lambda x: x["id"] == c)))
    got = got.withColumn("full_assessment", F.when(F.size("a.items") > 0, ordered).otherwise(F.array().cast(_ITEMS)))
    complete = F.size("full_assessment") == len(CRITERIA)
    got = got.withColumn("validation_errors", F.col("a.errors")).withColumn("complete", complete)
    got = got.withColumn("coherence_errors", coherence_errors(F.col("full_assessment"))).withColumn("hard_fails", F.when(F.col("complete"), hard_fails(F.col("full_assessment"))).otherwise(F.array().cast("array<string>")))
    valid = (F.size("validation_errors") == 0) & (F.size("coherence_errors") == 0)
    got = got.withColumn("valid", valid).withColumn("route", route(F.col("full_assessment"), F.col("valid") & F.col("complete")))
    return got.withColumn("accepted", accepted(F.col("category"), F.col("complete"), F.concat("validation_errors", F.transform("coherence_errors", lambda e: F.concat(F.lit("coherence: "), e))), F.col("hard_fails"), F.col("route"), F.col("expected"))).drop("a", "content")


# ---- evaluation of runs ----------------------------------------------------------------------------------------------


def is_valid(technical: Column, validation: Column, coherence: Column) -> Column:
    """No technical error and both error arrays there and empty; a missing array makes a row invalid."""
    return technical.isNull() & F.coalesce(F.size(validation) == 0, F.lit(False)) & F.coalesce(F.size(coherence) == 0, F.lit(False))


def coverage_errors(results: DataFrame, cases: DataFrame, replicates: int = 2) -> DataFrame:
    """``case_id, replicate, error``: what keeps results from covering every case once per replicate: foreign, repeated and missing pairs, wrong replicates."""
    expected = call_slots(cases.select("case_id").distinct(), replicates)
    counts = results.groupBy("case_id", F.col("replicate").cast("int").alias("replicate")).agg(F.count(F.lit(1)).alias("n"))
    ids = cases.select("case_id").distinct().withColumn("known", F.lit(True))
    seen = counts.join(ids, "case_id", "left")
    error = F.when(F.col("known").isNull(), "foreign").when(~F.coalesce(F.col("replicate").between(1, replicates), F.lit(False)), "invalid_replicate").when(F.col("n") > 1, "duplicate")
    bad = seen.select("case_id", "replicate", error.alias("error")).filter("error is not null")
    missing = expected.join(counts, ["case_id", "replicate"], "left_anti").select("case_id", "replicate", F.lit("missing").alias("error"))
    return bad.unionByName(missing)


def block_a(results: DataFrame, oracle: DataFrame, least: int = 2) -> DataFrame:
    """``replicate, oracle_hits, oracle_total, oracle_pass, include_false, exclude_routed_include``: results of block A against the oracle (``case_id, expected``)."""
    rows = results.filter("bloc = 'A'").join(oracle.select("case_id", F.col("expected").alias("wanted"), F.lit(True).alias("known")), "case_id", "left")
    total = oracle.agg(F.count(F.lit(1)).alias("oracle_total"))
    hit = F.col("valid") & F.col("known") & F.arrays_overlap("hard_fails", "wanted")
    out = rows.groupBy("replicate").agg(
        F.count_if(F.coalesce(hit, F.lit(False))).alias("oracle_hits"),
        F.count_if(F.col("valid") & (F.col("human_label") == "include") & (F.size("hard_fails") > 0)).alias("include_false"),
        F.count_if(F.col("valid") & (F.col("human_label") == "exclude") & (F.col("route") == "include")).alias("exclude_routed_include"),
    )
    # One row of totals.
    return out.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").select("replicate", "oracle_hits", "oracle_total", (F.col("oracle_hits") >= least).alias("oracle_pass"), "include_false", "exclude_routed_include")


def block_c(results: DataFrame, targets: DataFrame) -> DataFrame:
    """``criterion, cases, records, violations``: of the results of block C on target cases (``case_id, criterion``) those that are invalid or carry the criterion."""
    met = targets.join(results.filter("bloc = 'C'").select("case_id", "replicate", "valid", "hard_fails"), "case_id", "left")
    return met.groupBy("criterion").agg(F.countDistinct("case_id").alias("cases"), F.count("replicate").alias("records"), F.count_if(F.col("replicate").isNotNull() & (~F.col("valid") | F.array_contains("hard_fails", F.col("criterion")))).alias("violations"))


def target_violations(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """``case_id, criterion, violation`` of target cases: ``missing`` without a pair, ``reproduced`` where both replicates carry the criterion."""
    met = targets.join(pairs.select("case_id", "reproduced"), "case_id", "left")
    why = F.when(F.col("reproduced").isNull(), "missing").when(F.array_contains("reproduced", F.col("criterion")), "reproduced")
    return met.select("case_id", "criterion", why.alias("violation")).filter("violation is not null")


def criterion_stability(pairs: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """``criterion, pairs_n, identical_n``: complete valid pairs whose replicates agree on a criterion (both carry it or neither)."""
    good = pairs.filter("complete and valid")
    each = good.select(F.explode(F.array(*[F.lit(c) for c in criteria])).alias("criterion"), "observed", "reproduced")
    agree = F.expr("array_contains(observed, criterion) = array_contains(reproduced, criterion)")
    return each.groupBy("criterion").agg(F.count(F.lit(1)).alias("pairs_n"), F.count_if(agree).alias("identical_n"))


def verdict(results: DataFrame, oracle: DataFrame, targets: DataFrame, most_invalid: float = 0.10) -> DataFrame:
    """``criterion, status``: PASS or FAIL of each success criterion of a run, and the overall verdict, falsified if any but the stability fails.

    a: no missing evidence; b: invalid share; c: block A against its oracle; d: block C; e: no hard fail on an included case; f: nine of ten pairs identical, all complete.
    """
    rows = results
    errors = F.concat("validation_errors", "coherence_errors")
    pair = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.array_sort("hard_fails")).alias("sets"))
    a = rows.agg(F.count_if(F.exists(errors, lambda e: F.contains(e, F.lit("requires evidence")))).alias("x")).select(F.lit("a").alias("criterion"), (F.col("x") == 0).alias("ok"))
    b = rows.agg((F.count_if(~F.col("valid")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("x")).select(F.lit("b").alias("criterion"), (F.col("x") <= most_invalid).alias("ok"))
    c = block_a(rows, oracle).agg(F.coalesce(F.bool_and(F.col("oracle_pass") & (F.col("include_false") == 0) & (F.col("exclude_routed_include") == 0)), F.lit(False)).alias("ok")).select(F.lit("c").alias("criterion"), "ok")
    d = block_c(rows, targets).agg(F.coalesce(F.bool_and((F.col("violations") == 0) & (F.col("records") == 2 * F.col("cases"))), F.lit(False)).alias("ok")).select(F.lit("d").alias("criterion"), "ok")
    e = rows.agg(F.count_if(F.col("valid") & (F.col("human_label") == "include") & (F.size("hard_fails") > 0)).alias("x")).select(F.lit("e").alias("criterion"), (F.col("x") == 0).alias("ok"))
    f = pair.agg((F.count_if((F.col("n") == 2) & (F.col("sets") == 1)) / F.greatest(F.lit(1), F.count_if(F.col("n") == 2))).alias("x"), F.count_if(F.col("n") != 2).alias("y")).select(F.lit("f").alias("criterion"), ((F.col("x") >= 0.9) & (F.col("y") == 0)).alias("ok"))
    every = a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).unionByName(f)
    overall = every.agg(F.bool_and(F.col("ok") | (F.col("criterion") == "f")).alias("ok")).select(F.lit("overall").alias("criterion"), F.when(F.col("ok"), "not falsified").otherwise("falsified").alias("status"))
    return every.select("criterion", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status")).unionByName(overall)


def blocks(**named: DataFrame) -> DataFrame:
    """The cases of named blocks in one table with their ``bloc``."""
    out = None
    for name, cases in named.items():
        one = cases.withColumn("bloc", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def block_d_errors(rows: DataFrame, size: int = 5) -> list[str]:
    """What keeps the fresh block from being used: its columns, its size, blank labels."""
    missing = [c for c in ("doi", "title", "abstract", "label") if c not in rows.columns]
    if missing:
        return [f"missing columns {missing}"]
    n, blank = rows.agg(F.count(F.lit(1)), F.count_if(nonblank("label").isNull())).first()
    return ([f"{n} records instead of {size}"] if n != size else []) + (["empty label"] if blank else [])


def frozen_block(cases: DataFrame, ids: list[str], block: str) -> DataFrame:
    """The cases of a list in its order, with their ``bloc``; raises ValueError if one is missing. The list is a short, written one."""
    wanted = cases.sparkSession.createDataFrame(list(enumerate(ids)), "ordinal int, case_id string")
    lost = [r[0] for r in wanted.join(cases, "case_id", "left_anti").select("case_id").orderBy("case_id").collect()]
    if lost:
        raise ValueError(f"cases missing for block {block}: {', '.join(lost)}")
    return wanted.join(cases, "case_id").withColumn("bloc", F.lit(block)).orderBy("ordinal")


def check_allowlist(allowlist: tuple[str, ...], allowed: str = "I1_PROMPT_TECHNIQUE") -> frozenset[str]:
    """The allowlist of the assisted policy: empty or exactly the one criterion."""
    chosen = frozenset(allowlist)
    if chosen not in (frozenset(), frozenset({allowed})):
        raise ValueError(f"allowlist must be empty or {{{allowed}}}, got {sorted(chosen)}")
    return chosen


def is_title_only(variant: Column, flag: Column) -> Column:
    """Whether a case is judged by its title alone."""
    return F.coalesce(F.lower(variant).isin("title_only", "title-only"), F.lit(False)) | F.coalesce(flag, F.lit(False))


def assisted_routes(pairs: DataFrame, criterion: str, enabled: bool = True) -> DataFrame:
    """``case_id, reason`` of every pair under the assisted policy; the first reason that applies counts, and only ``proposal`` proposes an exclusion.

    ``pairs`` has ``case_id, complete, valid, human_label, observed, reproduced, title_only``.
    """
    held = F.array_contains("reproduced", criterion)
    reason = (
        F.when(~F.col("complete"), "incomplete_pair").when(~F.col("valid"), "invalid_pair").when((F.col("human_label") == "include") & held, "include_violation").when(~F.col("human_label").eqNullSafe("exclude"), "label_not_exclude")
        .when(F.col("title_only"), "title_only").when(F.lit(not enabled), "empty_allowlist").when(~held, "not_reproduced").when(F.size(F.array_except("observed", F.array(F.lit(criterion)))) > 0, "other_hard_fail").otherwise("proposal")
    )
    return pairs.select("case_id", reason.alias("reason"))


MATCHERS: dict[str, Callable[[str], str]] = {"span": span_text, "spaced": spaced_text}


def replay_counts(served: DataFrame, ids: tuple[str, ...] = MODEL_CRITERIA) -> DataFrame:
    """``run, total, before, after``: assessments of the oldest schema that hold under the plain and under the lenient matcher."""

    @F.pandas_udf("struct<before:boolean,after:boolean>")
    def both(content: pd.Series, title: pd.Series, abstract: pd.Series) -> pd.DataFrame:
        rows = []
        for c, t, a in zip(content, title, abstract):
            sources = {"title": t or "", "abstract": a or ""}
            rows.append(tuple(replay_valid(c, sources, ids, MATCHERS[m]) for m in ("spaced", "span")))
        return pd.DataFrame(rows, columns=["before", "after"])

    got = served.select("run", both("content", "title", "abstract").alias("v"))
    return got.groupBy("run").agg(F.count(F.lit(1)).alias("total"), F.count_if("v.before").alias("before"), F.count_if("v.after").alias("after"))
