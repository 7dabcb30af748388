"""Stages that put operators together: search, merging with its log, decisions of reviewers, extraction cells."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import REJECTED, exploitable, nonblank, strip
from reviewlake.operators import dedup, journal
from reviewlake.operators.identity import KINDS, connected_components, row_identity
from reviewlake.operators.screening import check_identities, dropzone_status
from reviewlake.session import cut
from reviewlake.sources.connectors import connector_metadata, search_source, with_provenance

META = "source string, endpoint string, api_version string, query_mode string, retrieved long, expected long, status string, reason string"

# ---- scoring and extraction as plug-ins ------------------------------------------------------------------------------

#: Scores rows: adds ``score, reason, model_served``; a null score goes to a human.
Scorer = Callable[[DataFrame], DataFrame]
#: Extracts cells: adds ``valeur, citation, section, retry_valeur, retry_citations``.
Extractor = Callable[[DataFrame], DataFrame]


def recorded_scorer(scores: DataFrame, key: str = "doc") -> Scorer:
    """A scorer that looks scores up; what is not recorded has none."""

    def score(rows: DataFrame) -> DataFrame:
        return rows.join(scores.select(key, "score", "reason", "model_served"), key, "left")

    return score


def recorded_extractor(cells: DataFrame, keys: tuple[str, ...] = ("doc", "variable")) -> Extractor:
    """An extractor that looks cells up; what is not recorded is an API error."""

    def extract(grid: DataFrame) -> DataFrame:
        found = grid.join(cells.select(*keys, "valeur", "citation", "section", "retry_valeur", "retry_citations"), list(keys), "left")
        return found.withColumn("valeur", F.coalesce("valeur", F.lit("ERREUR API")))

    return extract


# ---- search ----------------------------------------------------------------------------------------------------------


def search(spark: SparkSession, plan: Mapping[str, dict], transports: Mapping[str, Callable], day: str, files: DataFrame | None = None, **settings: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of all sources in the order of the plan, and one row of ``META`` per source. A source that fails leaves an error state and no rows.

    Every connector stops at its limit, so what one search brings to the driver is bounded.
    """
    rows, meta = None, []
    for source, query in plan.items():
        try:
            found, expected, status, reason = search_source(source, query, transports.get(source), **settings)
        except (NotImplementedError, ValueError) as e:
            found, expected, status, reason = [], None, "error", str(e)
        about = connector_metadata(source)
        meta.append((source, about["endpoint"], about["api_version"], about["query_mode"], len(found), expected, status, reason))
        if found:
            one = with_provenance(spark, found, source, query, day)
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        rows = with_provenance(spark, [], "", {}, day)
    rows = cut(rows.withColumn("row_id", F.monotonically_increasing_id()))
    known = files if files is not None else spark.createDataFrame([], "doi string")
    return rows.drop("pdf_status").join(dropzone_status(rows, known), "row_id"), spark.createDataFrame(meta, META)


def search_manifest(review: str, plan: Mapping[str, dict], meta: DataFrame, updated: str) -> dict:
    """What a manifest keeps of a search, with the worst state of its sources."""
    from reviewlake.operators.screening import global_status

    per_source = {r["source"]: {k: v for k, v in r.asDict().items() if k != "source"} for r in meta.collect()}
    return {"id": review, "stage": "search_done", "queries": dict(plan), "search_status": global_status(meta).first()[0], "search_meta": per_source, "updated": updated}


# ---- merging ---------------------------------------------------------------------------------------------------------


def merge_reason(kind: str, members: Column, kinds: Column, sources: Column, score: Column, threshold: float = dedup.THRESHOLD) -> Column:
    """Why a group was merged, in words, by the pass that merged it."""
    # The texts that the log of merges has.
    n, names = members.cast("string"), F.array_join(sources, ", ")
    if kind == "identity":
        return F.concat(F.lit("identité exacte ("), F.array_join(kinds, ", "), F.lit(") — "), n, F.lit(" copies fusionnées (sources: "), names, F.lit(")"))
    if kind == "title":
        return F.concat(F.lit("titre normalisé identique — "), n, F.lit(" versions fusionnées (années compatibles; sources: "), names, F.lit(")"))
    return F.concat(F.lit("titre similaire (ratio="), F.format_number(score, 3), F.lit(f", seuil={threshold:.3f}; années compatibles; au moins un DOI absent) — sources: "), names)


def merge_log(rows: DataFrame, groups: DataFrame, kind: str, scores: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """``component, best, removed, merged_ids, merged_dois, merged_sources, merged_id_records, score, reason`` of every group of several rows.

    ``scores`` (``component, score``) are the least similarities inside groups of similar titles; other passes score 1. A missing source is ``?``.
    """
    named = rows.withColumn("source", F.coalesce(nonblank("source"), F.lit("?")))
    log = dedup.audit(named, groups, key)
    log = log.join(scores, "component", "left") if scores is not None else log.withColumn("score", F.lit(1.0))
    kinds = F.array_sort(F.array_distinct(F.transform("merged_id_records", lambda x: x["type"])))
    return log.withColumn("reason", merge_reason(kind, F.col("removed") + 1, kinds, F.col("merged_sources"), F.col("score")))


def group_scores(pairs: DataFrame, groups: DataFrame, key: str = "row_id") -> DataFrame:
    """``component, score``: the least ratio between two members of a group of similar titles."""
    left, right = (groups.select(F.col(key).alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
    inside = pairs.join(left, "a").join(right, "b").filter("ca = cb")
    return inside.groupBy(F.col("ca").alias("component")).agg(F.round(F.min("ratio"), 3).alias("score"))


def merge(rows: DataFrame, key: str = "row_id", threshold: float = dedup.THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the three passes keep, their log, and per source the share that the title passes merged.

    Rows without an identifier abort the stage.
    """
    check_identities(rows, row_identity()["doc"], key)
    kept, logs, removed = rows, [], []
    for kind in ("identity", "title", "similar"):
        scores = None
        if kind == "identity":
            groups = connected_components(kept, key)
        elif kind == "title":
            groups = dedup.title_groups(kept, key)
        else:
            groups = dedup.fuzzy_groups(kept, key, threshold)
        groups = cut(groups)
        if kind == "similar":
            scores = group_scores(dedup.similar_title_pairs(kept, key, threshold), groups, key)
        logs.append(merge_log(kept, groups, kind, scores, key).withColumn("pass", F.lit(kind)))
        after = cut(dedup.apply_groups(kept, groups, key).drop("place", "members"))
        if kind != "identity":
            removed.append(kept.select(key, "source").join(after.select(key), key, "left_anti"))
        kept = after
    log = logs[0].unionByName(logs[1]).unionByName(logs[2])
    lost = removed[0].unionByName(removed[1]).groupBy("source").agg(F.count(F.lit(1)).alias("merged"))
    return kept, log, source_rates(rows, lost)


def source_rates(rows: DataFrame, lost: DataFrame, alarm: float = 0.10) -> DataFrame:
    """``source, records, merged, rate, alarm``: the share of each source that was merged away, flagged above ``alarm``."""
    total = rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    rate = F.coalesce("merged", F.lit(0)) / F.col("records")
    return total.join(lost, "source", "left").select("source", "records", F.coalesce("merged", F.lit(0)).alias("merged"), F.round(rate, 6).alias("rate"), (rate > alarm).alias("alarm"))


# ---- decisions of reviewers ----------------------------------------------------------------------------------------------


def case_identity(kinds: tuple[str, ...] = KINDS) -> Column:
    """``identity_type, doc`` of a queue row: its document if it names one, else its first identifier."""
    named = nonblank("doc")
    kind = F.when(named.isNotNull(), F.coalesce(nonblank("identity_type"), F.lit("doc"))).otherwise(F.coalesce(*[F.when(nonblank(k).isNotNull(), F.lit(k)) for k in kinds]))
    return F.struct(kind.alias("identity_type"), F.coalesce(named, *[nonblank(k) for k in kinds]).alias("doc"))


def apply_decisions(queue: DataFrame, decisions: DataFrame, history: DataFrame, stage: str = "human_review", stages: tuple[str, ...] = journal.HUMAN_SCREEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New journal lines, the cases that stay, and the decisions that were refused with the reason.

    ``queue`` has ``place`` (from 1), ``doc, identity_type, doi, source_id, oa_url, score, reason``; ``decisions`` has ``seq, key, decision`` where the key is an identity or else a place.
    A decision that repeats the last human one of its document is a replay and adds nothing, so applying twice changes nothing.
    """
    cases = queue.withColumn("i", case_identity()).select("place", "score", "reason", "source_id", "oa_url", F.col("i.identity_type").alias("identity_type"), F.col("i.doc").alias("doc"))
    by_doc = cases.filter("doc is not null").groupBy(F.col("doc").alias("key")).agg(F.max("place").alias("doc_place"))
    asked = decisions.select("seq", strip("key").alias("key"), strip("decision").alias("decision"))
    found = asked.join(by_doc, "key", "left").withColumn("place", F.coalesce("doc_place", F.when(F.col("key").rlike(r"^\d{1,9}$"), F.col("key").cast("int"))))
    met = found.drop("doc_place").join(cases, "place", "left")
    why = F.when(~F.coalesce(F.col("decision").isin("include", "exclude"), F.lit(False)), "invalid_decision").when(F.col("score").isNull() & F.col("doc").isNull() & F.col("identity_type").isNull() & ~F.col("known"), "unknown_case").when(F.col("doc").isNull(), "no_identity")
    met = met.join(cases.select("place", F.lit(True).alias("known")), "place", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    judged = met.withColumn("refused", why)
    last = history.filter(F.col("stage").isin(*stages) & F.col("decision").isin("include", "exclude") & nonblank("doc").isNotNull()).groupBy("doc").agg(F.max(F.struct("seq", "decision")).alias("x")).select("doc", F.lit(-1).cast("long").alias("seq"), F.col("x.decision").alias("decision"))
    good = judged.filter("refused is null")
    # The decisions of one document in order, with the last one of the journal in front: a change is one that differs from the one before it.
    every = good.select("doc", F.col("seq").cast("long").alias("seq"), "decision").unionByName(last.join(good.select("doc").distinct(), "doc", "left_semi"))
    steps = every.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seq", "decision"))).alias("xs"))
    changed = steps.select("doc", F.explode(F.filter(F.transform("xs", lambda x, i: F.struct(x["seq"].alias("seq"), x["decision"].alias("decision"), F.try_element_at("xs", F.when(i > 0, i))["decision"].alias("before"))), lambda x: (x["seq"] >= 0) & ~x["decision"].eqNullSafe(x["before"]))).alias("c"))
    new = good.withColumn("seq", F.col("seq").cast("long")).join(changed.select("doc", F.col("c.seq").alias("seq")), ["doc", "seq"], "left_semi")
    lines = new.select("seq", "doc", "identity_type", F.lit(stage).alias("stage"), "decision", "score", F.lit("human").alias("model"), F.lit("human").alias("actor"), F.coalesce("reason", F.lit("")).alias("reason"), "source_id", "oa_url")
    decided = last.select("doc").unionByName(good.select("doc")).unionByName(history.filter(F.col("stage").isin(*stages) & F.col("decision").isin("include", "exclude")).select("doc")).distinct()
    remaining = cases.join(decided, "doc", "left_anti").select("place", "identity_type", "doc", "score")
    return lines, remaining, judged.filter("refused is not null").select("seq", "key", "refused")


# ---- extraction ----------------------------------------------------------------------------------------------------------


def extraction_gate(retrieved: DataFrame, eligibility: DataFrame, stage_ran: bool) -> None:
    """Every retrieved document must be decided where full texts were screened; at most ten are named in the error."""
    if not stage_ran:
        return
    decided = eligibility.filter(F.col("decision").isin("include", "exclude")).select("identity_type", "doc")
    open_ = [r["doc"] for r in retrieved.join(decided, ["identity_type", "doc"], "left_anti").select("doc").orderBy("doc").limit(10).collect()]
    if open_:
        raise RuntimeError(f"documents without a final decision: {open_}")


def settle_cells(cells: DataFrame) -> DataFrame:
    """Extracted cells after the check of their citations: ``..., valeur, citation, section, outcome, retried``.

    ``cells`` has ``valeur, citation, section, retry_valeur, retry_citations, body`` and its keys. A value whose citation is not in the text word for word is rejected, unless a retry has a
    value and one of its first three citations is; outcomes are ``extracted, not_found, api_error, rejected_citation``.
    """
    from reviewlake.functions.text import citation_is_verifiable
    from reviewlake.functions.udfs import first_verifiable

    told = F.col("valeur").isin("NON TROUVÉ", "ERREUR API")
    held = cells.withColumn("ok", told | citation_is_verifiable("citation", "body"))
    wanted = ~F.col("ok") & F.col("retry_valeur").isNotNull()
    held = held.withColumn("rescue", F.when(wanted & exploitable("retry_valeur"), first_verifiable(F.when(wanted & exploitable("retry_valeur"), F.col("retry_citations")), F.col("body"))))
    value = F.when(F.col("ok"), F.col("valeur")).when(F.col("rescue").isNotNull(), F.col("retry_valeur")).otherwise(REJECTED)
    quote = F.when(F.col("ok"), F.col("citation")).otherwise(F.coalesce("rescue", F.lit("")))
    outcome = F.when(value == REJECTED, "rejected_citation").when(value == "ERREUR API", "api_error").when(value == "NON TROUVÉ", "not_found").otherwise("extracted")
    keep = [c for c in cells.columns if c not in ("valeur", "citation", "retry_valeur", "retry_citations", "body")]
    return held.select(*keep, value.alias("valeur"), quote.alias("citation"), outcome.alias("outcome"), wanted.alias("retried"))


def manifest_update(manifest: dict, **values: object) -> str:
    """A manifest with keys set, as JSON text; other keys stay."""
    return json.dumps({**manifest, **values}, ensure_ascii=False, indent=2)
