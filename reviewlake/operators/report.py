"""Reports: lookups of titles, exports, the flow diagram and Markdown of small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import cut, nonblank, parse_score
from reviewlake.operators.identity import exploded_identities, latest_by_identity

RIS_ABSTRACT = 500


def _with_candidate(docs: DataFrame, candidates: DataFrame, *fields: str) -> DataFrame:
    ids = latest_by_identity(candidates).select(F.col("kind").alias("identity_type"), F.col("value").alias("doc"), "row_id")
    return docs.join(ids, ["identity_type", "doc"], "left").join(candidates.select("row_id", *fields), "row_id", "left")


def titled(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``identity_type, doc, title``: the title of the last candidate that bears the identity, ``?`` without one."""
    return _with_candidate(docs, candidates, "title").select("identity_type", "doc", F.coalesce(nonblank("title"), F.lit("?")).alias("title"))


def review_list(queue: DataFrame, candidates: DataFrame, most: int = 250) -> DataFrame:
    """``identity_type, doc, abstract_cut, bucket``: a queue with the start of each abstract and how likely its score makes inclusion."""
    s = parse_score("score")
    bucket = F.when(s.isNull(), "unscored").when(s >= 0.6, "likely include").when(s <= 0.4, "likely exclude").otherwise("unclear")
    return _with_candidate(queue, candidates, "abstract").select("identity_type", "doc", cut(F.coalesce("abstract", F.lit("")), most).alias("abstract_cut"), bucket.alias("bucket"))


def with_abstract(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents with ``no_abstract``: whether the last candidate that bears the identity has none, or there is no such candidate."""
    found = _with_candidate(docs.select("identity_type", "doc").distinct(), candidates, "abstract").select("identity_type", "doc", nonblank("abstract").isNull().alias("no_abstract"))
    return docs.join(found, ["identity_type", "doc"])


def included_rows(included: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that bear any identity of an included document."""
    ids = exploded_identities(candidates).join(included.select(F.col("identity_type").alias("kind"), F.col("doc").alias("value")).distinct(), ["kind", "value"], "left_semi")
    return candidates.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def ris_lines(candidates: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, ris``: one tagged record per row; empty fields are left out, the abstract is cut."""

    def tag(name: str, value) -> F.Column:
        return F.when(nonblank(value).isNotNull(), F.concat(F.lit(f"{name}  - "), nonblank(value)))

    abstract = F.substring(F.regexp_replace(F.coalesce("abstract", F.lit("")), r"\s+", " "), 1, RIS_ABSTRACT)
    parts = [F.lit("TY  - JOUR"), tag("TI", "title"), tag("PY", "year"), tag("DO", "doi"), tag("UR", "oa_url"), tag("AB", abstract), F.lit("ER  - ")]
    return candidates.select(key, F.concat_ws("\n", *parts).alias("ris"))


def write_ris(candidates: DataFrame, path: str) -> None:
    """The records as text files."""
    ris_lines(candidates).select(F.concat("ris", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def mermaid(flow: dict[str, int]) -> str:
    """The flow diagram of a counter row; eligibility nodes only where full texts were screened."""
    n = {k: int(v or 0) for k, v in flow.items()}
    lines = ["flowchart TD", f'  A["identified: {n.get("identified", 0)}"] --> B["screened: {n.get("screened", 0)}"]', f'  B --> X1["excluded: {n.get("excluded", 0)}"]', f'  B --> C["included at screening: {n.get("included", 0)}"]']
    if n.get("pending"):
        lines.append(f'  B --> P["pending: {n["pending"]}"]')
    lines += [f'  C --> X2["not retrieved: {n.get("not_retrieved", 0)}"]', f'  C --> D["retrieved: {n.get("retrieved", 0)}"]']
    if n.get("fulltext_screened"):
        lines.append(f'  D --> E["full texts screened: {n["fulltext_screened"]}"]')
        lines.append(f'  E --> F["included: {n.get("included_final", 0)}"]')
    return "\n".join(lines)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a small result."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join("" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows)])


def report(title: str, flow: dict[str, int], tables: dict[str, DataFrame], shown: int = 200) -> str:
    """A Markdown report: the flow and small aggregate tables, each cut at ``shown`` rows for display."""
    parts = [f"# {title}", "```mermaid\n" + mermaid(flow) + "\n```"]
    for name, df in tables.items():
        rows = [r.asDict() for r in df.limit(shown).collect()]
        parts += [f"## {name}", markdown_table(rows, df.columns) if rows else "(none)"]
    return "\n\n".join(parts) + "\n"


def checklist(cases: list[dict]) -> str:
    """A checklist for humans: each case with its evidence and an empty verdict."""
    out = ["# Cases to check"]
    for c in cases:
        out += [f"## {c.get('case_id')}", *(f"- {k}: {v}" for k, v in c.items() if k != "case_id"), "- [ ] correct  - [ ] wrong"]
    return "\n\n".join(out) + "\n"
