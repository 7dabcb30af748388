"""Where stages write: queues, extraction tables, text files, manifests, snapshots, protocols, artefacts of runs."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import safe_document_filename
from reviewlake.session import cut
from reviewlake.sources.files import read_candidates, write_candidates

EXTRACTION = ("doi", "source_id", "oa_url", "doc", "identity_type", "variable", "valeur", "citation", "section")
EXTRACTION_DOI = ("doi", "variable", "valeur", "citation", "section")
SCORES = ("doi", "label", "stratum", "abstract_source", "score", "decision", "api_error_flag")


def write_queue(rows: DataFrame, path: str) -> None:
    """The open cases as JSON lines in place of those before, which may be what ``rows`` were read from."""
    cut(rows).write.mode("overwrite").json(path)


def write_extraction(cells: DataFrame, path: str) -> tuple[str, ...]:
    """The cells as CSV: five columns if every cell is of a DOI, else nine. Returns the columns."""
    other = not cells.filter(~F.col("identity_type").eqNullSafe("doi")).isEmpty()
    columns = EXTRACTION if other else EXTRACTION_DOI
    cells.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return columns


def write_markdown(texts: DataFrame, folder: str) -> None:
    """A file per document in a folder that all executors share, named safely after its identity; written where the rows are. Null texts are left out."""
    named = texts.filter("text is not null").select(safe_document_filename("identity_type", "doc").alias("name"), "text")
    os.makedirs(folder, exist_ok=True)

    def save(rows: Iterator[Row]) -> None:
        for r in rows:
            # A task that is tried again writes the same file again.
            with open(os.path.join(folder, f"{r['name']}.md.part"), "w", encoding="utf-8", newline="") as f:
                f.write(r["text"])
            os.replace(f.name, os.path.join(folder, f"{r['name']}.md"))

    named.foreachPartition(save)


def write_scores(scores: DataFrame, path: str) -> DataFrame:
    """Raw scores as CSV before anything is computed from them; what is computed reads them back."""
    scores.select(*SCORES).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return scores.sparkSession.read.schema(", ".join(f"{c} string" for c in SCORES)).option("header", True).option("escape", '"').csv(path).withColumn("score", F.col("score").cast("double")).withColumn("api_error_flag", F.col("api_error_flag") == "true")


def upsert_manifest(path: str, values: Mapping[str, object], drop: tuple[str, ...] = ()) -> dict:
    """A JSON object with keys set or dropped; other keys stay, and a missing file is an empty object."""
    have: dict = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            have = json.load(f)
    new = {k: v for k, v in have.items() if k not in drop} | dict(values)
    write_json(path, new)
    return new


def write_json(path: str, value: object) -> None:
    """A JSON file; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")
    os.replace(f"{path}.part", path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def snapshot(spark: SparkSession, candidates: str, raw: str, stage: str) -> DataFrame:
    """The candidates as the last search left them: refreshed after a search, made if there is none, else kept, so that merging can be repeated."""
    if stage == "search_done" or not os.path.exists(raw):
        write_candidates(read_candidates(spark, candidates), raw)
    return read_candidates(spark, raw)


def write_protocol(payload: Mapping, root: str) -> str:
    """The folder of a new review with protocol, counters and manifest; a payload with errors writes nothing."""
    from reviewlake.operators.screening import payload_errors

    errors = payload_errors(dict(payload))
    if errors:
        raise ValueError("; ".join(errors))
    base = os.path.join(root, payload["id"])
    for folder in ("sources", "inputs/pdfs"):
        os.makedirs(os.path.join(base, folder), exist_ok=True)
    sections = [("Question", [payload.get("question", "")]), ("Sources", [f"- {s['source']}: {s['reason']}" for s in payload["sources"]])]
    sections += [(title, [f"- {x}" for x in payload.get(key, [])]) for title, key in (("Criteria", "criteria"), ("Codebook", "codebook"))]
    with open(os.path.join(base, "protocol.md"), "w", encoding="utf-8") as f:
        f.write(f"# {payload['id']}\n" + "".join(f"\n## {t}\n\n" + "\n".join(lines) + "\n" for t, lines in sections))
    write_json(os.path.join(base, "prisma.json"), {"identified": 0})
    write_json(os.path.join(base, "manifest.json"), {"id": payload["id"], "stage": "protocol_done", "queries": {s["source"]: s["query"] for s in payload["sources"]}})
    return base


def digest(text: str) -> str:
    """The SHA-256 of a text in UTF-8."""
    return hashlib.sha256(text.encode()).hexdigest()


def replace_once(text: str, old: str, new: str) -> str:
    """A text with one place changed; raises ValueError unless the place is there exactly once."""
    if text.count(old) != 1:
        raise ValueError(f"expected one place, found {text.count(old)}")
    return text.replace(old, new)


def check_digests(texts: Mapping[str, str], digests: Mapping[str, str]) -> None:
    """Every pinned text must have its digest; raises ValueError with the names of those that differ or are missing."""
    wrong = sorted(n for n, d in digests.items() if n not in texts or digest(texts[n]) != d)
    if wrong:
        raise ValueError(f"texts differ from their digests: {wrong}")


def run_manifest(run: str, prompt: str, criteria: str, cases: list[str], models: list[str], replicates: int = 1, **more: object) -> dict:
    """What identifies a run: its name, the digests of what it was given, its cases, models and the number of calls."""
    return {"run_id": run, "prompt_sha256": digest(prompt), "criteria_sha256": digest(criteria), "case_ids": cases, "case_count": len(cases), "models": models, "n_replicates": replicates, "expected_call_slots": len(cases) * len(models) * replicates, **more}
