"""Screening: guards, protocol scans, scored routing and its counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import decide, nonblank, parse_score, strip

#: Search states from worst to best.
STATUS_RANK = {"error": 0, "incomplete": 1, "capped": 2, "complete": 3}
PROTOCOL_LEAST = 100


def check_thresholds(include_at: float, exclude_at: float) -> None:
    """Both in 0..1 and the lower one below the higher."""
    if not 0 <= exclude_at < include_at <= 1:
        raise ValueError(f"thresholds must satisfy 0 <= exclude < include <= 1, got {exclude_at} and {include_at}")


def check_search_complete(status: str) -> None:
    """Only a complete corpus may be screened; nothing overrides this."""
    if status != "complete":
        raise RuntimeError(f"corpus is not complete: {status}")


def check_identities(rows: DataFrame, identity: Column, key: str = "row_id", shown: int = 10) -> None:
    """Every row must have an identifier; at most ``shown`` rows are named in the error."""
    bad = [r[0] for r in rows.filter(identity.isNull()).orderBy(key).select(key).limit(shown).collect()]
    if bad:
        raise ValueError(f"rows without an identifier: {bad}")


def global_status(statuses: DataFrame) -> DataFrame:
    """One row: the worst search status; an unknown one is an error, none at all is complete."""
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    names = F.array(*[F.lit(k) for k, _ in sorted(STATUS_RANK.items(), key=lambda kv: kv[1])])
    worst = statuses.agg(F.min(F.coalesce(F.try_element_at(rank, F.col("status")), F.lit(0))).alias("r"))
    return worst.select(F.coalesce(F.element_at(names, F.col("r") + 1), F.lit("complete")).alias("status"))


def protocol_sufficiency(texts: DataFrame, key: str = "doc_id", text: str = "text", least: int = PROTOCOL_LEAST) -> DataFrame:
    """``key, n_visible, sufficient``: whether a protocol has enough characters other than white space."""
    n = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s", ""))
    return texts.select(key, n.alias("n_visible"), (n >= least).alias("sufficient"))


def section(text: Column, heading: str) -> Column:
    """The body of a Markdown section up to the next heading of its level; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?s)(?:^|\n)## {heading}[^\n]*\n(.*?)(?:\n## |$)", 1)


def criteria_of(texts: DataFrame, key: str = "doc_id", text: str = "text", heading: str = "Criteria") -> DataFrame:
    """``key, ordinal, criterion``: the bullets of the criteria section, in order. No shuffle: a text is scanned where it is."""
    lines = F.filter(F.transform(F.split(section(F.col(text), heading), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("- "))
    return texts.select(key, F.posexplode(lines).alias("at", "line")).select(key, (F.col("at") + 1).alias("ordinal"), F.trim(F.substring("line", 3, 1 << 30)).alias("criterion"))


def question_of(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, question``: the first line with anything in it after the question heading; null if there is none."""
    lines = F.filter(F.transform(F.split(section(F.col(text), "Question"), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(key, F.try_element_at(lines, F.lit(1)).alias("question"))


def codebook_of(texts: DataFrame, key: str = "doc_id", text: str = "text", heading: str = "Codebook") -> DataFrame:
    """``key, ordinal, name, description`` of ``- **name** : description`` bullets."""
    bullets = criteria_of(texts, key, text, heading)
    pattern = r"^\*\*(.+?)\*\*\s*:\s*(.*)$"
    return bullets.filter(F.col("criterion").rlike(pattern)).select(key, "ordinal", F.regexp_extract("criterion", pattern, 1).alias("name"), F.regexp_extract("criterion", pattern, 2).alias("description"))


def routed(journal: DataFrame, include_at: float = 0.75, exclude_at: float = 0.25, stages: tuple[str, ...] = ("screen_title_abstract", "screen_fulltext")) -> DataFrame:
    """``seq, stage, score, route``: the scores of machine lines, clamped, and where they route; unusable scores go to a human."""
    check_thresholds(include_at, exclude_at)
    scored = journal.filter(F.col("stage").isin(*stages)).select("seq", "stage", parse_score("score").alias("score"))
    return scored.withColumn("route", decide("score", include_at, exclude_at))


def route_counts(journal: DataFrame, **thresholds: float) -> DataFrame:
    """``stage, include_n, exclude_n, needs_manual_n, unusable_n`` per stage."""
    r = F.col("route")
    return routed(journal, **thresholds).groupBy("stage").agg(
        F.count_if(r == "include").alias("include_n"), F.count_if(r == "exclude").alias("exclude_n"), F.count_if(r == "needs_manual").alias("needs_manual_n"), F.count_if(F.col("score").isNull()).alias("unusable_n")
    )


def route_drift(journal: DataFrame, **thresholds: float) -> DataFrame:
    """``stage, decision, route, lines``: what the journal decided against what the score would route."""
    lines = journal.select("seq", strip("decision").alias("decision"))
    return routed(journal, **thresholds).join(lines, "seq").groupBy("stage", "decision", "route").agg(F.count(F.lit(1)).alias("lines"))


def dropzone_status(candidates: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, pdf_status``: ``dropzone`` if a file of the DOI is there, else the status that is set, else ``oa`` or ``none`` by the open address."""
    have = files.select(F.col("doi").alias("file_doi")).filter("file_doi is not null").distinct()
    joined = candidates.select(key, nonblank("doi").alias("doi"), nonblank("pdf_status").alias("set"), nonblank("oa_url").alias("url")).join(have, F.col("doi") == F.col("file_doi"), "left")
    status = F.when(F.col("file_doi").isNotNull(), "dropzone").when(F.col("set").isNotNull(), F.col("set")).when(F.col("url").isNotNull(), "oa").otherwise("none")
    return joined.select(key, status.alias("pdf_status"))


# ---- query contracts ---------------------------------------------------------------------------------------------

#: Fields of a structured query by source: required ones, optional ones, and the mode.
CONTRACTS: Mapping[str, tuple[tuple[str, ...], tuple[str, ...], str]] = {
    "openalex": (("query_mode", "search"), ("filter",), "search"),
    "pubmed": (("query_mode", "term"), (), "pubmed"),
    "eric": (("query_mode", "search"), ("sort",), "eric"),
}


def query_errors(query: object, source: str) -> list[str]:
    """What is wrong with a structured query; empty if it holds. Plain strings are refused."""
    if source not in CONTRACTS:
        return [f"unknown source {source}"]
    if not isinstance(query, dict):
        return ["query must be an object"]
    required, optional, mode = CONTRACTS[source]
    errors = [f"missing {k}" for k in required if k not in query]
    errors += [f"unknown {k}" for k in sorted(map(str, set(query) - {*required, *optional}))]
    if "query_mode" in query and query["query_mode"] != mode:
        errors.append(f"query_mode must be {mode}")
    return errors + [f"{k} must be a non-blank string" for k in (*required[1:], *optional) if k in query and not (isinstance(query[k], str) and query[k].strip())]


def prepared_query(query: dict, source: str) -> dict:
    """The mode and the parameters of a query that holds, as they are given; raises ValueError for others."""
    errors = query_errors(query, source)
    if errors:
        raise ValueError(f"{source}: {'; '.join(errors)}")
    return {"query_mode": query["query_mode"], "params": {k: v for k, v in query.items() if k != "query_mode"}}


def query_contract_errors(query: Column, source: str) -> Column:
    """The same of JSON texts, as an array of texts in the JVM; null for a null query."""
    required, optional, mode = CONTRACTS[source]
    keys = F.json_object_keys(query)
    value = lambda k: F.get_json_object(query, f"$.{k}")
    # A string member comes with its quotes as a raw value.
    text = lambda k: F.from_json(query, "map<string,string>")[k]
    held = lambda k: F.array_contains(keys, k)
    quoted = lambda k: query.rlike(rf'"{k}"\s*:\s*"')
    found = [F.when(~held(k), F.lit(f"missing {k}")) for k in required]
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in (*required, *optional)]))), lambda k: F.concat(F.lit("unknown "), k))
    after = [F.when(held("query_mode") & ~(quoted("query_mode") & F.coalesce(value("query_mode") == mode, F.lit(False))), F.lit(f"query_mode must be {mode}"))]
    after += [F.when(held(k) & ~(quoted(k) & F.coalesce(F.trim(text(k)) != "", F.lit(False))), F.lit(f"{k} must be a non-blank string")) for k in (*required[1:], *optional)]
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.when(query.isNull(), None).when(keys.isNull(), F.array(F.lit("query must be an object"))).otherwise(F.concat(some(found), extra, some(after)))


def plan_errors(sources: list[dict]) -> list[str]:
    """What is wrong with a source plan: at least one, known, unique, with a reason and a structured query of its mode."""
    if not isinstance(sources, list) or not sources:
        return ["at least one source is needed"]
    errors, seen = [], set()
    for number, s in enumerate(sources, 1):
        if not isinstance(s, dict):
            errors.append(f"source {number} must be an object")
            continue
        name = s.get("source")
        if name not in CONTRACTS:
            errors.append(f"unknown source {name}")
            continue
        if name in seen:
            errors.append(f"{name} is named twice")
        seen.add(name)
        if not (isinstance(s.get("reason"), str) and s["reason"].strip()):
            errors.append(f"{name} needs a reason")
        if not isinstance(s.get("query"), dict):
            errors.append(f"{name} needs a structured query")
        elif s["query"].get("query_mode") != CONTRACTS[name][2]:
            errors.append(f"{name}: query_mode must be {CONTRACTS[name][2]}")
    return errors


def payload_errors(payload: object) -> list[str]:
    """What is wrong with a review payload: an object with a slug (no blanks, no slashes) and a source plan."""
    if not isinstance(payload, dict):
        return ["payload must be an object"]
    slug = payload.get("id")
    if not isinstance(slug, str) or not slug or any(c in slug for c in " /\\"):
        return [f"invalid slug {slug!r}"]
    return plan_errors(payload.get("sources"))


def result_errors(result: object) -> list[str]:
    """What is wrong with a connector result (records, expected count, status, reason)."""
    if not (isinstance(result, tuple) and len(result) == 4):
        return ["result must have four parts"]
    records, expected, status, reason = result
    errors = []
    if not isinstance(records, list):
        errors.append("records must be a list")
    if expected is not None and (isinstance(expected, bool) or not isinstance(expected, int) or expected < 0):
        errors.append("expected must be a count")
    if status not in STATUS_RANK:
        errors.append("unknown status")
    if not isinstance(reason, str):
        errors.append("reason must be text")
    return errors
