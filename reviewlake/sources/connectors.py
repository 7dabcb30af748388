"""Paged sources as Python data sources: works, PubMed-like and ERIC-like searches.

A transport is a callable ``(params) -> (status code, text)``; the one that ships reads recorded pages
from a folder, so that everything runs offline. Failures become states of the search, never lost rows.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY_CODES, RETRY_DELAYS = (429, 500, 502, 503, 504), (1, 2, 4)
HARD_LIMIT, PAGE, BATCH, MAX_CURSOR_PAGES = 2000, 100, 200, 500
SCHEMA = "title string, doi string, source_id string, year string, abstract string, oa_url string"

Transport = Callable[[dict], tuple[int, str]]


class SearchError(RuntimeError):
    """A page that can never be had."""


class SearchIncomplete(RuntimeError):
    """A page that retries did not get."""


def fetch(transport: Transport, params: dict, sleep: Callable[[float], None] = time.sleep) -> str:
    """A page, with up to three retries on codes that may pass; no wait after the last."""
    for attempt in range(len(RETRY_DELAYS) + 1):
        code, text = transport(params)
        if code == 200:
            return text
        if code not in RETRY_CODES:
            raise SearchError(f"http_{code}")
        if attempt < len(RETRY_DELAYS):
            sleep(RETRY_DELAYS[attempt])
    raise SearchIncomplete(f"http_{code}")


@dataclass
class RateLimit:
    """At most so many requests a second."""

    per_second: float = 3.0
    last: float = field(default=-1e9)
    now: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def wait(self) -> None:
        gap = 1.0 / self.per_second - (self.now() - self.last)
        if gap > 0:
            self.sleep(gap)
        self.last = self.now()


def redact(message: str, secrets: list[str]) -> str:
    """A message without secrets, plain or URL-encoded."""
    from urllib.parse import quote

    for s in filter(None, secrets):
        message = message.replace(s, "***").replace(quote(s, safe=""), "***")
    return message


def limit_of(value: object, default: int = HARD_LIMIT) -> int:
    """A positive limit from a setting; the default for anything else."""
    text = str(value).strip() if value is not None else ""
    return int(text) if text.isdigit() and int(text) > 0 else default


def state_of(found: int, expected: int | None, limit: int) -> tuple[str, str]:
    """The state of a finished search and its reason."""
    if expected == 0:
        return "complete", "zero_results"
    if found >= limit and expected != limit:
        return "capped", "limit"
    if expected is not None and found < expected:
        return "incomplete", "missing_records"
    return "complete", ""


def works_record(item: dict) -> dict[str, str]:
    """The record of one work; null years and access fields are empty, never the word for null."""
    index = item.get("abstract_inverted_index") or {}
    at = sorted((p, w) for w, ps in index.items() for p in ps)
    by_place = dict(at)
    return {
        "title": item.get("title") or "",
        "doi": (item.get("doi") or "").replace("https://doi.org/", ""),
        "source_id": item.get("id") or "",
        "year": str(item["publication_year"]) if item.get("publication_year") is not None else "",
        "abstract": " ".join(by_place[p] for p in sorted(by_place)),
        "oa_url": (item.get("open_access") or {}).get("oa_url") or "",
    }


def scan_works(transport: Transport, query: dict, limit: object = None, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], int | None, str, str]:
    """Records, expected count, state and reason of a works search, page by page up to the limit."""
    limit = HARD_LIMIT if limit is None else limit_of(limit)
    rows: list[dict] = []
    expected: int | None = None
    cursor: str | None = None
    page = 1
    while True:
        params = {"search": query["search"], "per_page": PAGE} | ({"filter": query["filter"]} if query.get("filter") else {}) | ({"cursor": cursor} if cursor else {"page": page})
        try:
            data = json.loads(fetch(transport, params, sleep))
        except SearchError as e:
            return rows, expected, "error", str(e)
        except SearchIncomplete as e:
            return rows, expected, "incomplete", str(e)
        except ValueError:
            return rows, expected, "error", "invalid_json"
        count = (data.get("meta") or {}).get("count")
        results = data.get("results") or []
        if isinstance(count, bool) or not isinstance(count, int) or count < 0:
            return rows + [works_record(x) for x in results], expected, "incomplete", "invalid_count"
        if expected is None:
            expected = count
            if count > 10_000 and cursor is None:
                # Deep results need a cursor; the first page is fetched again through it.
                cursor = "*"
                continue
        rows += [works_record(x) for x in results]
        if len(rows) >= limit:
            rows = rows[:limit]
            break
        if not results or len(rows) >= expected or page >= MAX_CURSOR_PAGES:
            break
        page += 1
        if cursor:
            cursor = (data.get("meta") or {}).get("next_cursor")
            if not cursor:
                break
    return rows, expected, *state_of(len(rows), expected, limit)


def recorded(folder: str) -> Transport:
    """A transport over recorded answers: ``page-<n>.json``, or ``search.json`` and ``batch-<n>.xml``."""

    def get(params: dict) -> tuple[int, str]:
        name = f"batch-{params['batch']}.xml" if "batch" in params else "search.json" if params.get("step") == "search" else f"page-{params.get('page', 1)}.json"
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            return 404, ""
        with open(path, encoding="utf-8") as f:
            return 200, f.read()

    return get


@dataclass
class Pages(InputPartition):
    """One part of a search."""

    number: int


EMAIL_NEEDED, NO_COUNT, NO_HISTORY = "an email address is needed", "missing_or_invalid_expected_count", "missing_history_parameters"


def scan_articles(transport: Transport, query: dict, limit: object = None, email: str = "", api_key: str = "", sleep: Callable[[float], None] = time.sleep, rate: RateLimit | None = None) -> tuple[list[dict], int | None, str, str]:
    """Records, expected count, state and reason of an article search: one search with history, then batches up to the limit.

    A failed search is an error; a failed, unreadable or empty batch leaves the rows before it and makes the search incomplete.
    """
    import xml.etree.ElementTree as ET

    from reviewlake.functions.udfs import esearch_counts, pubmed_records

    if not email:
        return [], None, "error", EMAIL_NEEDED
    most = HARD_LIMIT if limit is None else limit_of(limit)
    common = {"db": "pubmed", "email": email} | ({"api_key": api_key} if api_key else {})
    rate = rate or RateLimit(sleep=sleep)

    def get(params: dict) -> str:
        if not api_key:
            rate.wait()
        try:
            return fetch(transport, common | params, sleep)
        except (SearchError, SearchIncomplete) as e:
            raise type(e)(redact(str(e), [email, api_key])) from None

    try:
        count, env, key = esearch_counts(get({"step": "search", "term": query["term"], "retmax": "0", "usehistory": "y", "sort": "relevance"}))
    except (SearchError, SearchIncomplete) as e:
        return [], None, "error", f"search: {e}"
    except (ValueError, ET.ParseError, AttributeError):
        return [], None, "incomplete", NO_COUNT
    if count is None:
        return [], None, "incomplete", NO_COUNT
    if count == 0:
        return [], 0, "complete", "zero_results"
    if not env or not key:
        return [], count, "incomplete", NO_HISTORY
    rows: list[dict] = []
    for number, start in enumerate(range(0, min(count, most), BATCH), 1):
        try:
            found = pubmed_records(get({"step": "fetch", "query_key": key, "WebEnv": env, "retstart": str(start), "retmax": str(min(BATCH, min(count, most) - start)), "batch": number}))
        except (SearchError, SearchIncomplete) as e:
            return rows, count, "incomplete", f"fetch: {e}"
        except ET.ParseError:
            return rows, count, "incomplete", f"invalid_efetch_xml_batch_{number}"
        if not found:
            return rows, count, "incomplete", f"empty_batch_{number}"
        rows += found
    if len(rows) < min(count, most):
        return rows, count, "incomplete", f"{len(rows)} of {count}"
    return rows[:most], count, *(("capped", f"limit {most}") if count > most else ("complete", ""))


FIELDS = ("title", "doi", "source_id", "year", "abstract", "oa_url")


class _Reader(DataSourceReader):
    """One search in one partition: rows, then the state of the search as a row of its own in the column ``state``."""

    def __init__(self, source: str, options: dict) -> None:
        self.source, self.options = source, options

    def partitions(self) -> list[InputPartition]:
        # Pages depend on the counts and cursors of the pages before them, and the request rate is one for all.
        return [Pages(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query = json.loads(self.options["query"])
        rows, expected, state, reason = search_source(self.source, query, recorded(self.options["path"]), self.options.get("limit"), self.options.get("email", ""), self.options.get("api_key", ""))
        for r in rows:
            yield (*(r.get(k, "") for k in FIELDS), None, None, None)
        yield (*(None for _ in FIELDS), expected, state, reason)


STATES = SCHEMA + ", expected long, state string, reason string"


def _source(name: str, source: str) -> type[DataSource]:
    class Source(DataSource):
        """Recorded answers of one search; options path, query (JSON), limit, email."""

        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return STATES

        def reader(self, schema) -> DataSourceReader:
            return _Reader(source, dict(self.options))

    Source.__name__ = Source.__qualname__ = f"{source.title()}Source"
    return Source


@dataclass(frozen=True)
class Connector:
    """A source: its scan, where it is, its version and the mode of its queries."""

    scan: Callable
    endpoint: str
    api_version: str
    query_mode: str
    format: str
    fetch_endpoint: str = ""


def register(spark: SparkSession) -> None:
    """Make the formats of all connectors known to the session."""
    for name, spec in REGISTRY.items():
        spark.dataSource.register(_source(spec.format, name))


def search_source(source: str, query: dict, transport: Transport, limit: object = None, email: str = "", api_key: str = "", sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], int | None, str, str]:
    """One search by the connector of a source. A query that breaks the contract of its source is an error state; an unknown source raises NotImplementedError, a result that breaks the contract ValueError."""
    from reviewlake.operators.screening import query_errors, result_errors

    if source not in REGISTRY:
        raise NotImplementedError(f"unknown source {source!r}; known: {', '.join(REGISTRY)}")
    errors = query_errors(query, source)
    if errors:
        return [], None, "error", "; ".join(errors)
    extra = {"email": email, "api_key": api_key} if source == "pubmed" else {}
    result = REGISTRY[source].scan(transport, query, limit=limit, sleep=sleep, **extra)
    broken = result_errors(result)
    if broken:
        raise ValueError(f"{source}: {'; '.join(broken)}")
    return result


#: The other name under which the dispatch is known.
mcp_search = search_source


def mock_search(source: str, query: dict, fixtures: dict[str, list[dict]]) -> tuple[list[dict], int | None, str, str]:
    """Fixed rows of a source, always complete; a query that breaks the contract is an error."""
    from reviewlake.operators.screening import query_errors

    errors = query_errors(query, source)
    rows = fixtures.get(source, [])
    return ([], None, "error", "; ".join(errors)) if errors else (rows, len(rows), "complete", "mock")


# Names under which a notice gives its fields, in order of precedence.
NOTICE_FIELDS = {
    "id": ("id", "ERICID", "ericid", "eric_id"), "title": ("title", "Title"), "year": ("publicationdateyear", "publicationDateYear", "publication_year", "year"), "abstract": ("description", "abstract", "Abstract"),
    "authors": ("author", "authors"), "publication_type": ("publicationtype", "publicationType", "publication_type"), "subjects": ("subject", "subjects", "descriptors"), "doi": ("doi", "DOI", "identifierdoi", "identifiersdoi"),
}
NOTICE_ADDRESSES = ("url", "URL", "ieslinkpublication", "e_fulltext", "fulltexturl", "full_text_url")
NOTICE_ADDRESS = "https://eric.ed.gov/?id="


def notice_record(notice: object) -> dict[str, str] | None:
    """The record of an ERIC notice: alternate names of fields, lists joined, the first DOI-looking token and web address. None without an id."""
    import re
    from urllib.parse import quote

    from reviewlake.functions.udfs import flatten_value

    if not isinstance(notice, dict):
        return None

    def given(*names: str) -> object:
        return next((notice[n] for n in names if notice.get(n) not in (None, "", [])), "")

    text = {k: flatten_value(given(*names)) for k, names in NOTICE_FIELDS.items()}
    if not text["id"]:
        return None
    addresses = [given(n) for n in NOTICE_ADDRESSES]
    tokens = (re.search(r"10\.\d{4,9}/[^\s\"<>]+", t, re.I) for t in [text["doi"], *map(flatten_value, addresses)])
    urls = (flatten_value(x) for a in addresses for x in (a if isinstance(a, list) else [a]))
    return {
        "title": text["title"],
        "doi": next((m[0].rstrip(".,;:)]}") for m in tokens if m), ""),
        "source_id": NOTICE_ADDRESS + quote(text["id"], safe=""),
        "year": text["year"],
        "abstract": text["abstract"],
        "oa_url": next((u for u in urls if u.startswith(("https://", "http://"))), ""),
        **{k: text[k] for k in ("authors", "publication_type", "subjects")},
    }


def notice_page(payload: str) -> tuple[int | None, list]:
    """Count and notices of one page; the envelope may be left out. Raises ValueError for other texts."""
    from reviewlake.functions.udfs import nonnegative_count

    parsed = json.loads(payload)
    body = parsed.get("response", parsed) if isinstance(parsed, dict) else None
    docs = body.get("docs") or [] if isinstance(body, dict) else None
    if not isinstance(docs, list):
        raise ValueError("invalid envelope")
    return nonnegative_count(body.get("numFound", body.get("numfound"))), docs


def scan_notices(transport: Transport, query: dict, limit: object = None, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], int | None, str, str]:
    """Records, expected count, state and reason of a notice search; the count must stay the same over the pages.

    A failure on the first page is an error, on a later one the search is incomplete and keeps its rows.
    """
    most = HARD_LIMIT if limit is None else limit_of(limit)
    rows: list[dict] = []
    expected: int | None = None
    start, page = 0, 1
    while True:
        size = min(200, max(20, (most if expected is None else min(expected, most)) - len(rows)))
        try:
            count, docs = notice_page(fetch(transport, {"search": query["search"], "start": start, "rows": size, "page": page} | ({"sort": query["sort"]} if "sort" in query else {}), sleep))
        except (SearchError, SearchIncomplete, ValueError) as e:
            return rows, expected, "error" if page == 1 else "incomplete", str(e)[:80]
        if count is None:
            return rows, expected, "incomplete", NO_COUNT
        if expected is not None and count != expected:
            return rows, expected, "incomplete", "count_changed"
        expected = count
        if expected == 0:
            return [], 0, "complete", "zero_results"
        if not docs:
            return rows, expected, "incomplete", f"empty_page_at_{start}"
        for doc in docs:
            record = notice_record(doc)
            if record is None:
                return rows, expected, "incomplete", "invalid_notice"
            rows.append(record)
            if len(rows) >= min(expected, most):
                return rows, expected, *(("capped", f"limit {most}") if expected > most else ("complete", ""))
        start, page = start + len(docs), page + 1


REGISTRY: dict[str, Connector] = {
    "openalex": Connector(scan_works, "https://api.openalex.org/works", "unversioned", "search", "works_pages"),
    "pubmed": Connector(scan_articles, "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", "NCBI E-utilities", "pubmed", "article_batches", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"),
    "eric": Connector(scan_notices, "https://api.ies.ed.gov/eric/", "ERIC API", "eric", "notice_pages"),
}


def connector_metadata(source: str) -> dict[str, str]:
    """What a manifest says of a source; an unknown one has an empty endpoint."""
    spec = REGISTRY.get(source)
    if spec is None:
        return {"endpoint": "", "api_version": "unknown", "query_mode": "unknown"}
    return {"endpoint": spec.endpoint, "api_version": spec.api_version, "query_mode": spec.query_mode} | ({"fetch_endpoint": spec.fetch_endpoint} if spec.fetch_endpoint else {})


def with_provenance(spark: SparkSession, rows: list[dict], source: str, query: dict, day: str) -> DataFrame:
    """Records of one search as candidate rows with the canonical JSON of their query."""
    text = json.dumps(query, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return spark.createDataFrame([tuple(r.get(k, "") for k in ("title", "doi", "source_id", "year", "abstract", "oa_url")) + ("", source, text, day) for r in rows], SCHEMA + ", pdf_status string, source string, query string, date string")
