"""Queries of the review operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.functions import udfs as U
from reviewlake.operators import calibration as cal
from reviewlake.operators import criteria as cr
from reviewlake.operators import dedup, extraction, identity, journal, screening
from reviewlake.operators import report as rep
from reviewlake.plans import sqltext as S
from reviewlake.session import cut, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its SQL."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def _c(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "candidates")


def _j(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "decisions")


def _e(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "extractions")


# ---- scalar functions -----------------------------------------------------------------------------------------

query("normalize_title", f"WITH {S.normal_form('candidates', 'row_id', 'title', 'n', True)} SELECT row_id, {S.title('t')} AS norm FROM n")(lambda s, d: _c(s, d).select("row_id", X.normalize_title("title").alias("norm")))
query(
    "normalize_identity_title", "WITH " + S.normal_form("candidates", "row_id", "title", "n", True) + r" SELECT row_id, trim(regexp_replace(t, '[^\p{L}\p{N}_]+', ' ', 'g')) AS norm FROM n"
)(lambda s, d: _c(s, d).select("row_id", X.normalize_identity_title("title").alias("norm")))
query(
    "doi_forms",
    rf"""SELECT row_id, replace(coalesce(doi, ''), 'https://doi.org/', '') AS clean, lower({S.strip("coalesce(doi, '')")}) AS canonical,
  regexp_replace(regexp_replace(lower({S.strip("coalesce(doi, '')")}), '^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*', ''), '[ .]+$', '') AS identity FROM candidates""",
)(lambda s, d: _c(s, d).select("row_id", X.clean_doi("doi").alias("clean"), X.canonical_doi("doi").alias("canonical"), X.normalize_identity_doi("doi").alias("identity")))
query(
    "safe_filename",
    rf"""WITH i AS (SELECT row_id, CASE WHEN {S.nb('doi')} IS NOT NULL THEN 'doi' WHEN {S.nb('source_id')} IS NOT NULL THEN 'source_id' WHEN {S.nb('oa_url')} IS NOT NULL THEN 'oa_url' END AS k,
  coalesce({S.nb('doi')}, {S.nb('source_id')}, {S.nb('oa_url')}) AS v FROM candidates)
SELECT row_id, CASE WHEN k = 'doi' THEN replace(v, '/', '_') ELSE k || '_' || substring(regexp_replace(regexp_replace(v, '[<>:"/\\|?*\s]', '_', 'g'), '[. ]+$', ''), 1, 100) || '_' || substring(sha256(v), 1, 12) END AS file_name FROM i WHERE k IS NOT NULL""",
)(lambda s, d: _c(s, d).select("row_id", identity.row_identity().alias("i")).filter("i.doc is not null").select("row_id", X.safe_document_filename("i.identity_type", "i.doc").alias("file_name")))
query(
    "identifier_tokens",
    rf"""SELECT row_id, nullif(regexp_replace(regexp_extract(coalesce(doi, ''), '(?i)(10\.\d{{4,9}}/[^\s"<>]+)', 1), '[.,;:)\]]+$', ''), '') AS doi_token,
  coalesce(CASE WHEN regexp_matches({S.strip('oa_url')}, '^https?://') THEN {S.strip('oa_url')} END, CASE WHEN regexp_matches({S.strip('source_id')}, '^https?://') THEN {S.strip('source_id')} END) AS url,
  nullif(regexp_extract({S.strip('oa_url')}, '^https?://(?:pmc\.ncbi\.nlm\.nih\.gov|www\.ncbi\.nlm\.nih\.gov/pmc)/articles/(PMC[0-9]+)(?:/pdf)?/?$', 1), '') AS pmcid FROM candidates""",
)(lambda s, d: _c(s, d).select("row_id", X.first_doi_token(F.coalesce("doi", F.lit(""))).alias("doi_token"), X.first_url("oa_url", "source_id").alias("url"), X.pmcid_of_url("oa_url").alias("pmcid")))
query("evidence_normalized", f"WITH {S.normal_form('fulltexts', 'text_id', 'fulltext', 'f')} SELECT text_id, sha256({S.evidence('t')}) AS digest, length({S.evidence('t')}) AS n FROM f")(
    lambda s, d: table(s, d, "fulltexts").select("text_id", F.sha2(X.normalize_evidence("fulltext"), 256).alias("digest"), F.length(X.normalize_evidence("fulltext")).alias("n"))
)
query(
    "span_normalized",
    f"WITH {S.normal_form('candidates', 'row_id', 'abstract', 'n', True)}, {S.normal_form('candidates', 'row_id', 'abstract', 'k')} SELECT row_id, "
    + rf"""trim(regexp_replace(replace(regexp_replace(translate(n.t, '‘’“”', repeat(chr(39), 2) || repeat(chr(34), 2)), '\\([%&_#])', '\1', 'g'), '~', ' '), '{S.SPACES}', ' ', 'g')) AS span, trim(regexp_replace(k.t, '{S.SPACES}', ' ', 'g')) AS span_v0 FROM n JOIN k USING (row_id)""",
)(lambda s, d: _c(s, d).select("row_id", X.normalize_span("abstract").alias("span"), X.collapse_space("abstract").alias("span_v0")))
query(
    "html_clean",
    r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM documents""",
)(lambda s, d: table(s, d, "documents").select("doc_id", X.strip_tags("text").alias("plain")))
query("prompt_sanitized", "SELECT doc_id, replace(replace(coalesce(text, ''), '<<<', '< < <'), '>>>', '> > >') AS safe FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", X.sanitize_delimiters("text").alias("safe"))
)
query("year_parsed", f"SELECT row_id, {S.year('year')} AS y FROM candidates")(lambda s, d: _c(s, d).select("row_id", X.parse_year("year").alias("y")))
query(
    "provenance_json",
    """SELECT row_id, '{' || concat_ws(',', CASE WHEN date IS NOT NULL THEN '"date":' || to_json(date) END, CASE WHEN query IS NOT NULL THEN '"query":' || to_json(query) END, CASE WHEN source IS NOT NULL THEN '"source":' || to_json(source) END) || '}' AS provenance FROM candidates""",
)(lambda s, d: _c(s, d).select("row_id", X.canonical_json(source=F.col("source"), query=F.col("query"), date=F.col("date")).alias("provenance")))
query("query_mode_counts", """SELECT json_extract_string(query, '$.query_mode') AS query_mode, source, count(*) AS records FROM candidates GROUP BY 1, 2""")(
    lambda s, d: _c(s, d).groupBy(F.get_json_object("query", "$.query_mode").alias("query_mode"), "source").agg(F.count(F.lit(1)).alias("records"))
)
query("text_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))


_SENTENCES = rf"""list_filter([regexp_replace(x, '^{S.SPACES}|{S.SPACES}$', '', 'g') FOR x IN string_split(regexp_replace(regexp_replace(regexp_replace(text, '^{S.SPACES}|{S.SPACES}$', '', 'g'),
  '(?i)\b(i\.e\.|e\.g\.|etc\.)({S.SPACES})', '\1' || chr(2) || '\2', 'g'), '([.!?]){S.SPACES}([A-Z<])', '\1' || chr(1) || '\2', 'g'), chr(1))], lambda x: x <> '')"""


@query(
    "sentence_segments",
    f"""SELECT doc_id, 'S' || i AS source, replace(ss[i], chr(2), '') AS text FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ss) + 1)) t(i)""",
)
def _sentences(s: SparkSession, d: str) -> DataFrame:
    """Numbered sentences of every document. The SQL marks abbreviations first and cuts at marks, as it has no look-behind."""
    docs = table(s, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.explode(X.sentence_records("text")).alias("x")).select("doc_id", "x.source", "x.text")


@query("inverted_abstract", r"""SELECT row_id, array_to_string(list_filter(string_split_regex(coalesce(abstract, ''), '\s+'), lambda x: x <> ''), ' ') AS abstract_text FROM candidates""")
def _inverted(s: SparkSession, d: str) -> DataFrame:
    """Abstracts turned into inverted indexes and rebuilt from them."""
    words = F.filter(F.split(F.coalesce("abstract", F.lit("")), r"\s+"), lambda x: x != "")
    # Each row makes its own index: the places of every distinct word.
    rows = _c(s, d).select("row_id", words.alias("ws"))
    places = lambda w: F.filter(F.transform("ws", lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    index = F.map_from_entries(F.transform(F.array_distinct("ws"), lambda w: F.struct(w.alias("w"), places(w).alias("ps"))))
    return rows.select("row_id", X.reconstruct_abstract(index).alias("abstract_text"))


# ---- identity and merging --------------------------------------------------------------------------------------------

query(
    "identity_coalesce",
    f"""SELECT row_id, CASE WHEN {S.nb('doi')} IS NOT NULL THEN 'doi' WHEN {S.nb('source_id')} IS NOT NULL THEN 'source_id' WHEN {S.nb('oa_url')} IS NOT NULL THEN 'oa_url' END AS identity_type,
  coalesce({S.nb('doi')}, {S.nb('source_id')}, {S.nb('oa_url')}) AS doc FROM candidates""",
)(lambda s, d: _c(s, d).select("row_id", identity.row_identity().alias("i")).select("row_id", "i.identity_type", "i.doc"))
query("identity_explode", S.COMPONENTS.replace("SELECT DISTINCT row_id", "SELECT row_id") + " SELECT row_id, kind, value FROM ids")(lambda s, d: identity.exploded_identities(_c(s, d)))
query("candidate_lookup", S.COMPONENTS + " SELECT kind, value, max(row_id) AS row_id FROM ids GROUP BY kind, value")(lambda s, d: identity.latest_by_identity(_c(s, d)))
query("dedup_exact_identity", S.COMPONENTS + " SELECT row_id, component FROM components")(lambda s, d: identity.connected_components(_c(s, d)))
query(
    "dedup_best_row", S.COMPONENTS + f" SELECT component, max_by(row_id, {S.QUALITY}) AS best, min(row_id) AS first, count(*) AS members FROM candidates JOIN components USING (row_id) GROUP BY component"
)(lambda s, d: dedup.merge_groups(_c(s, d), cut(identity.connected_components(_c(s, d)))))
query(
    "dedup_merge_rate",
    S.COMPONENTS
    + f""", kept AS (SELECT component, max_by(row_id, {S.QUALITY}) AS best FROM candidates JOIN components USING (row_id) GROUP BY component)
SELECT source, count(*) AS records, count(*) FILTER (WHERE best IS NULL) AS merged, round(count(*) FILTER (WHERE best IS NULL) / count(*), 6) AS rate,
  count(*) FILTER (WHERE best IS NULL) / count(*) > 0.1 AS alarm FROM candidates c LEFT JOIN kept ON kept.best = c.row_id GROUP BY source""",
)(lambda s, d: dedup.merge_rates(_c(s, d), cut(identity.connected_components(_c(s, d)))))


@query(
    "dedup_audit",
    S.COMPONENTS
    + """ SELECT component, count(*) - 1 AS removed, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT doi2) AS dois
FROM (SELECT c.*, k.component, CASE WHEN trim(doi) = '' THEN NULL ELSE """
    + S.nb("doi")
    + """ END AS doi2 FROM candidates c JOIN components k USING (row_id)) GROUP BY component HAVING count(*) > 1""",
)
def _audit(s: SparkSession, d: str) -> DataFrame:
    rows = _c(s, d)
    out = dedup.audit(rows, cut(identity.connected_components(rows)))
    return out.select("component", "removed", F.array_join("merged_sources", ",").alias("sources"), F.size("merged_dois").cast("long").alias("dois"))


#: First-fit groups of equal titles over the rows of ``k`` (row_id, t, y).
_FOLD = """o AS (SELECT t, y, first, row_number() OVER (PARTITION BY t ORDER BY first) AS i FROM (SELECT t, y, min(row_id) AS first FROM k GROUP BY t, y)),
fold AS (SELECT t, y, i, first AS component, [{'lo': y, 'hi': y, 'c': first}] AS gs FROM o WHERE i = 1
  UNION ALL
  SELECT t, y, i, CASE WHEN p = 0 THEN first ELSE gs[p].c END, CASE WHEN p = 0 THEN list_append(gs, {'lo': y, 'hi': y, 'c': first}) ELSE list_transform(gs, lambda g, j: CASE WHEN j = p THEN {'lo': least(g.lo, y), 'hi': greatest(g.hi, y), 'c': g.c} ELSE g END) END
  FROM (SELECT o.t, o.y, o.i, o.first, f.gs, coalesce(list_position(list_transform(f.gs, lambda g: o.y IS NULL OR g.lo IS NULL OR (g.hi - o.y <= 1 AND o.y - g.lo <= 1)), TRUE), 0) AS p FROM fold f JOIN o ON o.t = f.t AND o.i = f.i + 1))"""
_KEYED = f"{S.normal_form('candidates', 'row_id', 'title', 'n', True)}, k AS (SELECT row_id, {S.title('t')} AS t, {S.year('year')} AS y FROM n JOIN candidates USING (row_id) WHERE {S.title('t')} <> '')"
query(
    "dedup_title_groups",
    f"""WITH RECURSIVE {_KEYED},
{_FOLD}
SELECT k.row_id, f.component FROM k JOIN fold f ON f.t = k.t AND f.y IS NOT DISTINCT FROM k.y""",
)(lambda s, d: dedup.title_groups(_c(s, d)))
query(
    "title_merge_rate",
    f"""WITH RECURSIVE {_KEYED}, {_FOLD}, g AS (SELECT k.row_id, f.component FROM k JOIN fold f ON f.t = k.t AND f.y IS NOT DISTINCT FROM k.y), kept AS (SELECT max_by(row_id, {S.QUALITY}) AS best FROM g JOIN candidates USING (row_id) GROUP BY component)
SELECT source, count(*) AS records, count(*) FILTER (WHERE g.row_id IS NOT NULL AND best IS NULL) AS merged, round(count(*) FILTER (WHERE g.row_id IS NOT NULL AND best IS NULL) / count(*), 6) AS rate, count(*) FILTER (WHERE g.row_id IS NOT NULL AND best IS NULL) / count(*) > 0.1 AS alarm
FROM candidates c LEFT JOIN g USING (row_id) LEFT JOIN kept ON kept.best = c.row_id GROUP BY source""",
)(lambda s, d: dedup.merge_rates(_c(s, d), cut(dedup.title_groups(_c(s, d)))))
query(
    "merged_by_two_passes",
    S.COMPONENTS.replace("WITH ids", "WITH RECURSIVE ids", 1)
    + f""", first_pass AS MATERIALIZED (SELECT max_by(row_id, {S.QUALITY}) AS row_id FROM candidates JOIN components USING (row_id) WHERE coalesce({S.nb('doi')}, {S.nb('source_id')}, {S.nb('oa_url')}) IS NOT NULL GROUP BY component),
{_KEYED.replace("k AS (SELECT row_id", "k AS (SELECT row_id", 1).replace("JOIN candidates USING (row_id)", "JOIN candidates USING (row_id) JOIN first_pass USING (row_id)")},
{_FOLD}, g AS (SELECT k.row_id, f.component FROM k JOIN fold f ON f.t = k.t AND f.y IS NOT DISTINCT FROM k.y)
SELECT max_by(row_id, {S.QUALITY}) AS row_id FROM first_pass JOIN candidates USING (row_id) LEFT JOIN g USING (row_id) GROUP BY coalesce(g.component, row_id)""",
)(lambda s, d: dedup.deduplicate(_c(s, d).filter(identity.row_identity()["doc"].isNotNull()), fuzzy=False).select("row_id"))
query(
    "gold_metadata",
    f"""{S.GOLD}, last AS (SELECT lower({S.strip("coalesce(doi, '')")}) AS k, max_by({{'y': year, 'p': publication_type}}, row_id) AS x FROM candidates WHERE lower({S.strip("coalesce(doi, '')")}) <> '' GROUP BY 1)
SELECT doc AS doi, label, x.y AS year, x.p AS publication_type FROM gold LEFT JOIN last ON last.k = lower({S.strip("coalesce(doc, '')")}) WHERE identity_type = 'doi'""",
)(lambda s, d: cal.with_metadata(_gold(s, d).filter("identity_type = 'doi'").select(F.col("doc").alias("doi"), "label"), _c(s, d), "year", "publication_type"))
query("fuzzy_title_pairs")(lambda s, d: dedup.similar_title_pairs(_c(s, d)).select("a", "b", F.round("ratio", 6).alias("ratio")))


@query("deduplicated")
def _deduplicated(s: SparkSession, d: str) -> DataFrame:
    """What the three passes keep of the candidates that have an identifier."""
    rows = _c(s, d).filter(identity.row_identity()["doc"].isNotNull())
    return dedup.deduplicate(rows).select("row_id", "title", "doi", "source")


query(
    "merged_identities",
    f"""SELECT seq, len(merged_ids) AS n_ids, array_to_string(list_sort(list_distinct(merged_dois)), ',') AS dois, len(list_distinct([x.type FOR x IN merged_id_records])) AS kinds FROM decisions WHERE stage = 'dedup' AND merged_ids IS NOT NULL""",
)(
    lambda s, d: _j(s, d)
    .filter("stage = 'dedup' and merged_ids is not null")
    .select("seq", F.size("merged_ids").cast("long").alias("n_ids"), F.array_join(F.sort_array(F.array_distinct("merged_dois")), ",").alias("dois"), F.size(F.array_distinct(F.transform("merged_id_records", lambda x: x["type"]))).cast("long").alias("kinds"))
)

# ---- journal ---------------------------------------------------------------------------------------------------------

query("vocab_unknown_entries", f"SELECT stage, decision, count(*) AS lines FROM decisions WHERE NOT coalesce({S.KNOWN}, FALSE) GROUP BY stage, decision")(lambda s, d: journal.unknown_entries(_j(s, d)))
query("resolve_screening", f"{S.JOURNAL}, {S.SCREEN} SELECT * FROM screen")(lambda s, d: journal.resolve_screening(_j(s, d)))
query("resolve_eligibility", f"{S.JOURNAL}, {S.ELIGIBLE} SELECT * FROM eligible")(lambda s, d: journal.resolve_eligibility(_j(s, d)))
query(
    "resolve_stage_review",
    f"WITH {S.LINES}, known AS (SELECT * FROM lines), {S.SCREEN} SELECT * FROM screen",
)(lambda s, d: journal.resolve(_j(s, d), journal.MACHINE_SCREEN, journal.HUMAN_SCREEN, known_only=False))
query("resolve_latest_fulltext", f"{S.JOURNAL}, {S.FULLTEXT} SELECT * FROM got")(lambda s, d: journal.latest_fulltext(_j(s, d)))
query(
    "latest_human",
    f"{S.JOURNAL} SELECT k AS identity_type, d AS doc, max_by(decision, seq) AS decision, max(seq) AS seq FROM lines WHERE stage IN ('human_review', 'screen_manual', 'human_review_fulltext') AND decision IN ('include', 'exclude') GROUP BY k, d",
)(lambda s, d: journal.latest_human(_j(s, d)))
query("review_queue_remaining", f"{S.JOURNAL}, {S.QUEUE} SELECT * FROM queue")(lambda s, d: journal.review_queue(_j(s, d)))
query(
    "replayed_decisions",
    f"""{S.JOURNAL}, seen AS (SELECT seq, k AS identity_type, d AS doc, stage, decision, lag(decision) OVER (PARTITION BY k, d, stage ORDER BY seq) AS before FROM known WHERE stage IN ('human_review', 'screen_manual', 'human_review_fulltext'))
SELECT seq, identity_type, doc, stage, decision FROM seen WHERE before = decision""",
)(lambda s, d: journal.replayed_decisions(_j(s, d)))
query(
    "journal_counts",
    f"""{S.JOURNAL} SELECT stage, count(*) FILTER (WHERE decision = 'include') AS include_n, count(*) FILTER (WHERE decision = 'exclude') AS exclude_n, count(*) FILTER (WHERE decision = 'needs_manual') AS needs_manual_n,
  count(*) FILTER (WHERE decision NOT IN ('include', 'exclude', 'needs_manual')) AS other_n FROM known GROUP BY stage""",
)(lambda s, d: journal.decision_counts(_j(s, d)))
query("served_models", f"SELECT stage, array_to_string(list_sort(list(DISTINCT m)), ', ') AS models FROM (SELECT stage, {S.nb('model_served')} AS m FROM decisions) WHERE m IS NOT NULL GROUP BY stage")(lambda s, d: journal.served_models(_j(s, d)))
query("final_exclusions", f"{S.JOURNAL}, {S.ELIGIBLE} SELECT e.identity_type, e.doc, e.resolved_by, {S.nb('j.criterion')} AS criterion, {S.nb('j.reason')} AS reason FROM eligible e JOIN decisions j ON j.seq = e.decided_seq WHERE e.decision = 'exclude'")(
    lambda s, d: journal.final_exclusions(_j(s, d))
)
query(
    "resume_next_action",
    f"""{S.JOURNAL}, last AS (SELECT run, max_by(stage, seq) AS stage FROM known GROUP BY run),
per_doc AS (SELECT run, k, d, max_by(decision, seq) FILTER (WHERE stage = 'screen_title_abstract') AS m, count(*) FILTER (WHERE stage IN ('human_review', 'screen_manual')) AS h FROM known GROUP BY run, k, d),
queues AS (SELECT run, count(*) FILTER (WHERE m = 'needs_manual' AND h = 0) AS queue FROM per_doc GROUP BY run),
done AS (SELECT * FROM (VALUES ('dedup', 'dedup_done', 'screen', 'screen'), ('screen_title_abstract', 'screen_done', 'review', 'fulltext'), ('human_review', 'review_done', 'fulltext', 'fulltext'), ('screen_manual', 'review_done', 'fulltext', 'fulltext'),
  ('fulltext', 'fulltext_done', 'screen-fulltext', 'screen-fulltext'), ('screen_fulltext', 'screen_fulltext_done', 'review-fulltext', 'extract'), ('human_review_fulltext', 'review_fulltext_done', 'extract', 'extract'), ('extract', 'extract_done', 'report', 'report')) t(stage, last_stage, full_a, empty_a))
SELECT run, last_stage, queue, CASE WHEN queue > 0 THEN full_a ELSE empty_a END AS action FROM last JOIN queues USING (run) JOIN done USING (stage)""",
)(lambda s, d: journal.next_actions(_j(s, d)))
query(
    "prisma_flow",
    f"""{S.JOURNAL}, {S.SCREEN}, {S.ELIGIBLE}, {S.FULLTEXT}, {S.QUEUE}, one AS (SELECT (SELECT count(*) FROM candidates) AS identified, (SELECT count(*) FROM screen) AS screened, (SELECT count(*) FROM screen WHERE decision = 'include') AS included,
  (SELECT count(*) FROM queue) AS pending, (SELECT count(*) FROM got) AS retrieved, (SELECT count(*) FROM eligible) AS fulltext_screened, (SELECT count(*) FROM eligible WHERE decision = 'include') AS included_final)
SELECT *, greatest(0, screened - included - pending) AS excluded, greatest(0, included - retrieved) AS not_retrieved FROM one""",
)(lambda s, d: journal.flow(_j(s, d), _c(s, d)))
query(
    "exclusion_titles",
    f"""{S.JOURNAL}, {S.ELIGIBLE}, ids AS (SELECT kind, value, max(row_id) AS row_id FROM (SELECT row_id, 'doi' AS kind, {S.nb('doi')} AS value FROM candidates UNION ALL SELECT row_id, 'source_id', {S.nb('source_id')} FROM candidates UNION ALL SELECT row_id, 'oa_url', {S.nb('oa_url')} FROM candidates) WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT e.identity_type, e.doc, coalesce({S.nb('c.title')}, '?') AS title FROM eligible e LEFT JOIN ids ON ids.kind = e.identity_type AND ids.value = e.doc LEFT JOIN candidates c USING (row_id) WHERE e.decision = 'exclude'""",
)(lambda s, d: rep.titled(journal.resolve_eligibility(_j(s, d)).filter("decision = 'exclude'").select("identity_type", "doc"), _c(s, d)))
query(
    "review_list",
    f"""{S.JOURNAL}, {S.QUEUE}, ids AS (SELECT kind, value, max(row_id) AS row_id FROM (SELECT row_id, 'doi' AS kind, {S.nb('doi')} AS value FROM candidates UNION ALL SELECT row_id, 'source_id', {S.nb('source_id')} FROM candidates UNION ALL SELECT row_id, 'oa_url', {S.nb('oa_url')} FROM candidates) WHERE value IS NOT NULL GROUP BY 1, 2),
scored AS (SELECT q.*, {S.score('q.score')} AS s FROM queue q)
SELECT q.identity_type, q.doc, substring(coalesce(c.abstract, ''), 1, 250) AS abstract_cut, CASE WHEN s IS NULL THEN 'unscored' WHEN s >= 0.6 THEN 'likely include' WHEN s <= 0.4 THEN 'likely exclude' ELSE 'unclear' END AS bucket
FROM scored q LEFT JOIN ids ON ids.kind = q.identity_type AND ids.value = q.doc LEFT JOIN candidates c USING (row_id)""",
)(lambda s, d: rep.review_list(journal.review_queue(_j(s, d)), _c(s, d)))
_RIS_ABSTRACT = S.nb(r"substring(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g'), 1, 500)")
_TAG = "CASE WHEN {0} IS NOT NULL THEN '{1}  - ' || {0} END"
query(
    "ris_text",
    "SELECT row_id, concat_ws(chr(10), 'TY  - JOUR', "
    + ", ".join(_TAG.format(S.nb(c), t) for c, t in (("title", "TI"), ("year", "PY"), ("doi", "DO"), ("oa_url", "UR")))
    + f", CASE WHEN {_RIS_ABSTRACT} IS NOT NULL THEN 'AB  - ' || {_RIS_ABSTRACT} END, 'ER  - ') AS ris FROM candidates",
)(lambda s, d: rep.ris_lines(_c(s, d)))
query("nested_clean", """SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'A & b; c' WHEN 1 THEN 'plain x' ELSE 'inner' END AS t FROM candidates""")(
    lambda s, d: _c(s, d).select("row_id", U.clean_nested(F.when(F.col("row_id") % 3 == 0, '["A &amp; <i>b</i>", null, ["c", true]]').when(F.col("row_id") % 3 == 1, " plain \n x ").otherwise('{"value": {"text": "inner"}, "label": "no"}')).alias("t"))
)
query(
    "ris_included",
    f"""{S.JOURNAL}, {S.ELIGIBLE}, inc AS (SELECT identity_type, doc FROM eligible WHERE decision = 'include')
SELECT row_id FROM candidates WHERE EXISTS (SELECT 1 FROM inc WHERE (identity_type = 'doi' AND doc = {S.nb('doi')}) OR (identity_type = 'source_id' AND doc = {S.nb('source_id')}) OR (identity_type = 'oa_url' AND doc = {S.nb('oa_url')}))""",
)(lambda s, d: rep.included_rows(journal.resolve_eligibility(_j(s, d)).filter("decision = 'include'"), _c(s, d)).select("row_id"))

# ---- screening ---------------------------------------------------------------------------------------------------------

_ROUTED = f"r AS (SELECT seq, stage, decision, {S.score('score')} AS score FROM decisions WHERE stage IN ('screen_title_abstract', 'screen_fulltext')), rr AS (SELECT *, CASE WHEN score IS NULL THEN 'needs_manual' WHEN score >= 0.75 THEN 'include' WHEN score <= 0.25 THEN 'exclude' ELSE 'needs_manual' END AS route FROM r)"
query("screen_route", f"WITH {_ROUTED} SELECT seq, stage, score, route FROM rr")(lambda s, d: screening.routed(_j(s, d)))
query(
    "screen_counts",
    f"WITH {_ROUTED} SELECT stage, count(*) FILTER (WHERE route = 'include') AS include_n, count(*) FILTER (WHERE route = 'exclude') AS exclude_n, count(*) FILTER (WHERE route = 'needs_manual') AS needs_manual_n, count(*) FILTER (WHERE score IS NULL) AS unusable_n FROM rr GROUP BY stage",
)(lambda s, d: screening.route_counts(_j(s, d)))
query("screen_drift", f"WITH {_ROUTED} SELECT stage, {S.strip('decision')} AS decision, route, count(*) AS lines FROM rr GROUP BY 1, 2, 3")(lambda s, d: screening.route_drift(_j(s, d)))
query("protocol_sufficient", r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n_visible, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) >= 100 AS sufficient FROM documents WHERE genre = 'protocol'")(
    lambda s, d: screening.protocol_sufficiency(table(s, d, "documents").filter("genre = 'protocol'"))
)


def _section(h: str) -> str:
    return rf"list_filter([trim(x) FOR x IN string_split_regex(regexp_extract(coalesce(text, ''), '(?s)(?:^|\n)## {h}[^\n]*\n(.*?)(?:\n## |$)', 1), '\r?\n')]"


query(
    "protocol_criteria",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS ordinal, trim(substring(ls[i], 3)) AS criterion FROM (SELECT doc_id, {_section('Criteria')}, lambda x: starts_with(x, '- ')) AS ls FROM documents WHERE genre = 'protocol'), unnest(range(1, len(ls) + 1)) t(i)""",
)(lambda s, d: screening.criteria_of(table(s, d, "documents").filter("genre = 'protocol'")))
query("protocol_question", f"SELECT doc_id, {_section('Question')}, lambda x: x <> '')[1] AS question FROM documents WHERE genre = 'protocol'")(lambda s, d: screening.question_of(table(s, d, "documents").filter("genre = 'protocol'")))
query(
    "dropzone_status",
    f"""WITH files AS (SELECT DISTINCT {S.nb('doc')} AS doi FROM fulltexts WHERE channel = 'dropzone' AND {S.KIND} = 'doi' AND {S.nb('doc')} IS NOT NULL)
SELECT row_id, CASE WHEN f.doi IS NOT NULL THEN 'dropzone' WHEN {S.nb('pdf_status')} IS NOT NULL THEN {S.nb('pdf_status')} WHEN {S.nb('oa_url')} IS NOT NULL THEN 'oa' ELSE 'none' END AS pdf_status
FROM candidates c LEFT JOIN files f ON f.doi = {S.nb('c.doi')}""",
)(lambda s, d: screening.dropzone_status(_c(s, d), table(s, d, "fulltexts").filter((F.col("channel") == "dropzone") & (F.coalesce(X.nonblank("identity_type"), F.lit("doi")) == "doi")).select(X.nonblank("doc").alias("doi"))))
query(
    "search_status_worst",
    """WITH st AS (SELECT source, CASE WHEN count(*) FILTER (WHERE coalesce(trim(title), '') = '') > 0 THEN 'incomplete' WHEN count(*) >= 2000 THEN 'capped' ELSE 'complete' END AS status FROM candidates GROUP BY source)
SELECT coalesce(min_by(status, CASE status WHEN 'error' THEN 0 WHEN 'incomplete' THEN 1 WHEN 'capped' THEN 2 ELSE 3 END), 'complete') AS status FROM st""",
)(
    lambda s, d: screening.global_status(
        _c(s, d).groupBy("source").agg(F.when(F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "") > 0, "incomplete").when(F.count(F.lit(1)) >= 2000, "capped").otherwise("complete").alias("status"))
    )
)

# ---- extraction ----------------------------------------------------------------------------------------------------------

_CELLS = f"""cells AS (SELECT {S.KIND} AS identity_type, {S.nb('doc')} AS doc, {S.nb('variable')} AS variable, {S.strip('valeur')} AS value, citation,
  CASE WHEN coalesce({S.strip('valeur')}, '') = '' THEN 'blank' WHEN {S.strip('valeur')} = 'NON TROUVÉ' THEN 'not_found' WHEN {S.strip('valeur')} = 'ERREUR API' THEN 'api_error' WHEN {S.strip('valeur')} = 'CITATION REJETÉE' THEN 'rejected' ELSE 'value' END AS state FROM extractions)"""
query(
    "extraction_counts",
    f"""WITH {_CELLS} SELECT variable, count(*) AS attempted, count(*) FILTER (WHERE state = 'value') AS cell_values, count(*) FILTER (WHERE state = 'not_found') AS not_found, count(*) FILTER (WHERE state = 'api_error') AS api_errors,
  count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) FILTER (WHERE state = 'blank') AS blank, count(DISTINCT identity_type || chr(1) || doc) AS articles, count(DISTINCT CASE WHEN state = 'value' THEN identity_type || chr(1) || doc END) AS articles_with_data
FROM (SELECT * REPLACE (coalesce(variable, '(none)') AS variable) FROM cells) GROUP BY ROLLUP (variable)""",
)(lambda s, d: extraction.extraction_counts(_e(s, d)))
query(
    "values_by_variable",
    f"WITH {_CELLS}, v AS (SELECT DISTINCT variable, value FROM cells WHERE state = 'value'), n AS (SELECT variable, value, CAST(row_number() OVER (PARTITION BY variable ORDER BY value) AS INTEGER) AS ordinal FROM v) SELECT * FROM n WHERE ordinal <= 10",
)(lambda s, d: extraction.values_by_variable(_e(s, d)))
query(
    "extraction_wide",
    f"WITH {_CELLS} SELECT identity_type, doc, " + ", ".join(f"min(value) FILTER (WHERE variable = '{v}') AS {v}" for v in extraction.VARIABLES) + " FROM cells WHERE state = 'value' AND doc IS NOT NULL GROUP BY 1, 2",
)(lambda s, d: extraction.wide(_e(s, d)))
query(
    "extraction_missing_cells",
    f"""{S.JOURNAL}, {S.ELIGIBLE}, {_CELLS}, g AS (SELECT DISTINCT identity_type, doc, v.variable FROM eligible, (VALUES {", ".join(f"('{v}')" for v in extraction.VARIABLES)}) v(variable) WHERE decision = 'include')
SELECT g.variable, count(*) AS expected, count(*) FILTER (WHERE c.doc IS NULL) AS missing FROM g LEFT JOIN (SELECT DISTINCT identity_type, doc, variable FROM cells) c USING (identity_type, doc, variable) GROUP BY 1""",
)(lambda s, d: extraction.missing_cells(journal.resolve_eligibility(_j(s, d)).filter("decision = 'include'"), _e(s, d)))
query("extraction_repeats", f"WITH {_CELLS} SELECT identity_type, doc, variable, count(*) AS cells, count(DISTINCT value) AS distinct_values FROM cells WHERE doc IS NOT NULL AND variable IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")(
    lambda s, d: extraction.repeated_cells(_e(s, d))
)
query(
    "quote_verifiable",
    f"""WITH e AS (SELECT row_number() OVER () AS rid, * FROM extractions), {S.normal_form('e', 'rid', 'citation', 'ec')}, {S.normal_form('fulltexts', 'text_id', 'fulltext', 'ft')},
q AS (SELECT DISTINCT {S.KIND} AS identity_type, {S.nb('doc')} AS doc, {S.evidence('t')} AS citation FROM e JOIN ec USING (rid) WHERE {S.nb('doc')} IS NOT NULL AND {S.evidence('t')} <> ''),
b AS (SELECT {S.KIND} AS identity_type, {S.nb('doc')} AS doc, {S.evidence('t')} AS body FROM fulltexts JOIN ft USING (text_id) WHERE {S.nb('doc')} IS NOT NULL AND {S.evidence('t')} <> '')
SELECT identity_type, doc, citation, coalesce(bool_or(contains(body, citation)), FALSE) AS verifiable FROM q LEFT JOIN b USING (identity_type, doc) GROUP BY 1, 2, 3""",
)(lambda s, d: extraction.verifiable_citations(_e(s, d), table(s, d, "fulltexts")))

# ---- calibration -----------------------------------------------------------------------------------------------------------


def _gold(s: SparkSession, d: str) -> DataFrame:
    return cal.gold_scores(_j(s, d))


query("gold_scores", f"{S.GOLD} SELECT * FROM gold")(_gold)
query("confusion_raw", f"{S.GOLD} " + S.ratios(f"SELECT {S.matrix()} FROM routed", "tp, fp, fn, tn"))(lambda s, d: cal.confusion(_gold(s, d)))
query("per_stratum", f"{S.GOLD} " + S.ratios(f"SELECT stratum, count(*) AS n, {S.matrix()} FROM routed GROUP BY stratum", "stratum, n, tp, fp, fn, tn"))(lambda s, d: cal.per_stratum(_gold(s, d)))
_WEIGHTS = "w AS (SELECT stratum, count(*) AS population, count(score) AS sampled, round(CASE WHEN count(score) = 0 THEN 0.0 ELSE count(*) / count(score) END, 6) AS weight FROM gold GROUP BY stratum)"
query("sampling_weights", f"{S.GOLD}, {_WEIGHTS} SELECT * FROM w")(lambda s, d: cal.sampling_weights(_gold(s, d)))
query(
    "confusion_weighted",
    f"{S.GOLD}, {_WEIGHTS} SELECT round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tn, 4) AS tn, recall, precision, f1 FROM (" + S.ratios(f"SELECT {S.matrix('p', 'weight')} FROM routed JOIN w USING (stratum)") + ")",
)(lambda s, d: cal.weighted_confusion(_gold(s, d)))
query(
    "sensitivity",
    f"{S.GOLD}, ids AS (SELECT kind, value, max(row_id) AS row_id FROM (SELECT row_id, 'doi' AS kind, {S.nb('doi')} AS value FROM candidates UNION ALL SELECT row_id, 'source_id', {S.nb('source_id')} FROM candidates UNION ALL SELECT row_id, 'oa_url', {S.nb('oa_url')} FROM candidates) WHERE value IS NOT NULL GROUP BY 1, 2), "
    + f"bare AS (SELECT r.*, {S.nb('c.abstract')} IS NULL AS u FROM routed r LEFT JOIN ids ON ids.kind = r.identity_type AND ids.value = r.doc LEFT JOIN candidates c USING (row_id)), scen AS ("
    + S.ratios(f"SELECT sc, {S.matrix('CASE WHEN u THEN sc ELSE p END')} FROM bare, (VALUES (TRUE), (FALSE)) t(sc) GROUP BY sc")
    + ") SELECT min(recall) AS recall_min, max(recall) AS recall_max, min(precision) AS precision_min, max(precision) AS precision_max FROM scen",
)(lambda s, d: cal.sensitivity(rep.with_abstract(_gold(s, d), _c(s, d)), F.col("no_abstract")))
query(
    "threshold_menu",
    f"{S.GOLD}, {_WEIGHTS}, m AS (SELECT ti::DOUBLE AS ti, ti::DOUBLE - 0.5::DOUBLE AS te FROM (VALUES (0.85), (0.80), (0.75), (0.70), (0.65)) t(ti)), raw AS ("
    + S.ratios(f"SELECT ti, te, {S.matrix('score >= ti')}, count(*) AS n, count(*) FILTER (WHERE score > te AND score < ti) AS ambiguous FROM routed, m GROUP BY ti, te")
    + "), heavy AS ("
    + S.ratios(f"SELECT ti, {S.matrix('score >= ti', 'weight')} FROM routed JOIN w USING (stratum), m GROUP BY ti")
    + ") SELECT raw.ti, te, n, raw.tp, raw.fp, raw.fn, raw.tn, raw.recall, raw.precision, raw.f1, heavy.recall AS weighted_recall, heavy.precision AS weighted_precision, heavy.f1 AS weighted_f1, round(100.0::DOUBLE * ambiguous / n, 1) AS ambiguous_pct FROM raw JOIN heavy USING (ti)",
)(lambda s, d: cal.threshold_menu(_gold(s, d)))
query(
    "score_histogram",
    f"{S.GOLD}, b AS (SELECT CAST(least(floor((score + 1e-12::DOUBLE) / 0.05::DOUBLE), 19) AS INTEGER) AS bin, count(*) AS n FROM gold WHERE score IS NOT NULL GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) r LEFT JOIN b ON b.bin = r.range",
)(lambda s, d: cal.score_histogram(_gold(s, d)))
query("score_summary", f"{S.GOLD} SELECT count(*) AS n, round(min(score), 4) AS min, round(max(score), 4) AS max, round(avg(score), 4) AS mean, round(median(score), 4) AS median FROM gold WHERE score IS NOT NULL")(lambda s, d: cal.score_summary(_gold(s, d)))
query(
    "coverage",
    f"{S.GOLD} SELECT total, evaluated, round(r, 4) AS ratio, CASE WHEN evaluated < 5 OR r < 0.8 THEN 'failed' WHEN evaluated < total THEN 'partial' ELSE 'complete' END AS state FROM (SELECT count(*) AS total, count(score) AS evaluated, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(score) / count(*) END AS r FROM gold)",
)(lambda s, d: cal.coverage(_gold(s, d)))

# ---- criteria ----------------------------------------------------------------------------------------------------------------


def _a(s: SparkSession, d: str) -> DataFrame:
    return cr.journal_assessments(_j(s, d))


def _p(s: SparkSession, d: str) -> DataFrame:
    return cr.pair_summaries(_a(s, d))


_ASSESS = rf"""WITH l AS (SELECT seq, {S.KIND} AS identity_type, {S.nb('doc')} AS case_id, regexp_extract(run, '^run-(\d{{4}})-\d{{2}}-([a-z])$', 1) AS bloc, regexp_extract(run, '^run-(\d{{4}})-\d{{2}}-([a-z])$', 2) AS replicate,
  stage, decision, {S.nb('criterion')} AS criterion, {S.nb('reason')} AS reason FROM decisions WHERE regexp_matches(run, '^run-(\d{{4}})-\d{{2}}-([a-z])$') AND {S.nb('doc')} IS NOT NULL),
lab AS (SELECT identity_type, case_id, max_by(decision, seq) AS human_label FROM l WHERE stage IN ('human_review', 'human_review_fulltext') AND decision IN ('include', 'exclude') GROUP BY 1, 2),
g AS (SELECT identity_type, case_id, bloc, replicate, coalesce(list_sort(list(DISTINCT criterion) FILTER (WHERE decision = 'exclude' AND criterion IS NOT NULL)), []::VARCHAR[]) AS hard_fails,
  coalesce(list_sort(list(DISTINCT err) FILTER (WHERE err IS NOT NULL)), []::VARCHAR[]) AS errors, count(*) FILTER (WHERE decision = 'needs_manual') AS unclear
  FROM (SELECT *, CASE WHEN reason = 'quote not found' THEN 'quote not found in source' WHEN decision = 'rejected_citation' THEN 'evidence requires evidence' WHEN decision = 'api_error' THEN 'technical: call failed' END AS err FROM l)
  WHERE stage IN ('screen_title_abstract', 'screen_fulltext', 'extract') GROUP BY 1, 2, 3, 4),
a AS (SELECT identity_type, case_id, bloc, replicate, hard_fails, errors, len(errors) = 0 AS valid, coalesce(human_label, '(missing)') AS human_label,
  CASE WHEN len(errors) > 0 THEN 'invalid_assessment' WHEN len(hard_fails) > 0 OR unclear > 0 THEN 'needs_manual' ELSE 'include' END AS route FROM g LEFT JOIN lab USING (identity_type, case_id)),
p0 AS (SELECT identity_type, case_id, bloc, count(*) = 2 AS complete, count(*) = 2 AND bool_and(valid) AS valid, max(human_label) AS human_label, list_sort(list_distinct(flatten(list(hard_fails)))) AS observed, list(list_sort(hard_fails)) AS sets FROM a WHERE replicate IN ('a', 'b') GROUP BY 1, 2, 3),
p1 AS (SELECT *, CASE WHEN valid THEN list_sort(list_filter(observed, lambda x: len(list_filter(sets, lambda s: list_contains(s, x))) = len(sets))) ELSE []::VARCHAR[] END AS reproduced FROM p0),
p AS (SELECT identity_type, case_id, bloc, complete, valid, human_label, observed, reproduced, complete AND len(list_distinct(sets)) = 1 AS identical FROM p1)
"""
query("assessments", _ASSESS + "SELECT * FROM a")(_a)
query(
    "route_pivot",
    _ASSESS + "SELECT human_label, count(*) FILTER (WHERE route = 'include') AS include_n, count(*) FILTER (WHERE route = 'needs_manual') AS needs_manual_n, count(*) FILTER (WHERE route = 'invalid_assessment') AS invalid_n, count(*) AS total FROM a GROUP BY ROLLUP (human_label)",
)(lambda s, d: cr.route_table(_a(s, d)))
query("hard_fail_contingency", _ASSESS + "SELECT criterion, human_label, valid, count(*) AS n FROM (SELECT unnest(hard_fails) AS criterion, human_label, valid FROM a) GROUP BY 1, 2, 3")(lambda s, d: cr.hard_fail_table(_a(s, d)))
query(
    "invalid_grouping_sets",
    _ASSESS + "SELECT bloc, replicate, count(*) AS rows_n, count(*) FILTER (WHERE NOT valid) AS invalid_n, round(count(*) FILTER (WHERE NOT valid) / count(*), 6) AS rate FROM a GROUP BY GROUPING SETS ((bloc, replicate), ())",
)(lambda s, d: cr.invalid_rates(_a(s, d)))
query(
    "stratification",
    _ASSESS
    + f"SELECT coalesce({S.nb('bloc')}, '(missing)') AS stratum, count(*) AS records, count(*) FILTER (WHERE human_label = 'include') AS include_n, count(*) FILTER (WHERE human_label = 'exclude') AS exclude_n, count(*) FILTER (WHERE valid) AS valid_n, count(*) FILTER (WHERE NOT valid) AS invalid_n, count(*) FILTER (WHERE route = 'needs_manual') AS manual_n FROM a GROUP BY 1",
)(lambda s, d: cr.stratification(_a(s, d)))


def _taxonomy_sql(version: str) -> str:
    whens = []
    for needles, name in cr.TAXONOMIES[version]:
        cond = " OR ".join(f"contains(lower(e), '{n}')" for n in needles)
        whens.append(f"WHEN ({cond})" + (" AND contains(lower(e), 'declared ')" if name == "source-label mismatch" else "") + f" THEN '{name}'")
    return _ASSESS + f"SELECT CASE {' '.join(whens)} ELSE 'other validation' END AS error_class, count(*) AS n FROM (SELECT unnest(errors) AS e FROM a) GROUP BY 1"


for _v in cr.TAXONOMIES:
    query(f"error_taxonomy_{_v}", _taxonomy_sql(_v))(lambda s, d, v=_v: cr.error_taxonomy(_a(s, d), v))

_RULES = """h AS (SELECT criterion, count(*) FILTER (WHERE human_label = 'include') AS include_hits, count(DISTINCT CASE WHEN human_label = 'exclude' THEN identity_type || chr(1) || case_id END) AS exclude_cases FROM (SELECT unnest({f}) AS criterion, * FROM {t} WHERE valid{w}) GROUP BY 1)
SELECT criterion, coalesce(include_hits, 0) AS include_hits, coalesce(exclude_cases, 0) AS exclude_cases, CASE WHEN coalesce(include_hits, 0) > 0 THEN 'disqualified' WHEN coalesce(exclude_cases, 0) < 3 THEN 'not_qualified' ELSE 'qualified' END AS verdict
FROM (VALUES ('E1'), ('E2'), ('E3'), ('E4'), ('E5'), ('E6')) v(criterion) LEFT JOIN h USING (criterion)"""
query("candidate_rules", _ASSESS + ", " + _RULES.format(f="hard_fails", t="a", w=""))(lambda s, d: cr.candidate_rules(_a(s, d)))
query("terminal_rules", _ASSESS + ", " + _RULES.format(f="reproduced", t="p", w=" AND complete"))(lambda s, d: cr.terminal_rules(_p(s, d)))
query(
    "allowlist_simulation",
    _ASSESS
    + "SELECT count(*) FILTER (WHERE human_label = 'exclude') AS exclude_rows, count(*) FILTER (WHERE human_label = 'exclude' AND list_has_any(hard_fails, ['E1', 'E4'])) AS exclude_hits, count(*) FILTER (WHERE human_label = 'include' AND list_has_any(hard_fails, ['E1', 'E4'])) AS include_hits, round(CASE WHEN count(*) FILTER (WHERE human_label = 'exclude') = 0 THEN 0 ELSE count(*) FILTER (WHERE human_label = 'exclude' AND list_has_any(hard_fails, ['E1', 'E4'])) / count(*) FILTER (WHERE human_label = 'exclude') END, 6) AS automation_rate FROM a WHERE valid",
)(lambda s, d: cr.simulate_allowlist(_a(s, d), ("E1", "E4")))
query("pair_reproduced", _ASSESS + "SELECT * FROM p")(_p)
query(
    "stability_by_block", _ASSESS + "SELECT bloc, count(*) AS pairs_n, count(*) FILTER (WHERE identical) AS identical_n, round(count(*) FILTER (WHERE identical) / count(*), 6) AS rate FROM p WHERE complete AND valid GROUP BY ROLLUP (bloc)"
)(lambda s, d: cr.stability(_p(s, d)))
query("reproduced_contingency", _ASSESS + "SELECT criterion, human_label, count(*) AS n FROM (SELECT unnest(reproduced) AS criterion, human_label FROM p) GROUP BY 1, 2")(lambda s, d: cr.reproduced_table(_p(s, d)))
query("unsafe_includes", _ASSESS + "SELECT identity_type, case_id, bloc, reproduced FROM p WHERE human_label = 'include' AND len(reproduced) > 0")(lambda s, d: cr.unsafe_includes(_p(s, d)))
query(
    "assisted_policy",
    _ASSESS
    + """SELECT CASE WHEN NOT complete THEN 'incomplete_pair' WHEN NOT valid THEN 'invalid_pair' WHEN human_label = 'include' AND list_contains(reproduced, 'E1') THEN 'include_violation' WHEN human_label = '(missing)' THEN 'label_missing'
  WHEN len(observed) = 0 THEN 'no_hard_fail' WHEN NOT list_contains(observed, 'E1') THEN 'not_allowlisted' WHEN NOT list_contains(reproduced, 'E1') THEN 'not_reproduced' WHEN len(observed) > 1 THEN 'other_hard_fail' ELSE 'proposal' END AS reason, count(*) AS n FROM p GROUP BY 1""",
)(lambda s, d: cr.assisted_policy(_p(s, d)))
query(
    "rule3_sample",
    _ASSESS
    + "SELECT criterion, case_id, rank FROM (SELECT criterion, case_id, CAST(row_number() OVER (PARTITION BY criterion ORDER BY sha256(case_id || ':' || criterion), case_id) AS INTEGER) AS rank FROM (SELECT DISTINCT unnest(hard_fails) AS criterion, case_id FROM a WHERE human_label = 'exclude')) WHERE rank <= 5",
)(
    lambda s, d: cr.hash_sample(_a(s, d).filter("human_label = 'exclude'").select(F.explode("hard_fails").alias("criterion"), "case_id").distinct(), "criterion", F.concat("case_id", F.lit(":"), "criterion"), "case_id", 5).select(
        "criterion", "case_id", "rank"
    )
)
query(
    "holdout_hash_topk",
    f"{S.GOLD} SELECT label, doc, rank FROM (SELECT label, doc, CAST(row_number() OVER (PARTITION BY label ORDER BY sha256(lower(doc)), doc) AS INTEGER) AS rank FROM (SELECT DISTINCT label, doc FROM gold)) WHERE rank <= 3",
)(lambda s, d: cr.hash_sample(_gold(s, d).select("label", "doc").distinct(), "label", F.lower("doc"), "doc", 3).select("label", "doc", "rank"))
query(
    "fresh_candidates",
    f"""{S.GOLD}, u AS (SELECT lower({S.strip('doi')}) AS doi, min(row_id) AS row_id, min_by(title, row_id) AS title FROM candidates WHERE lower({S.strip("coalesce(doi, '')")}) <> '' AND {S.nb('title')} IS NOT NULL AND {S.nb('abstract')} IS NOT NULL GROUP BY 1)
SELECT doi, row_id, title FROM u WHERE doi NOT IN (SELECT lower({S.strip('doc')}) FROM gold WHERE identity_type = 'doi') ORDER BY sha256(doi) LIMIT 5""",
)(lambda s, d: cr.fresh_candidates(_c(s, d), _gold(s, d).filter("identity_type = 'doi'").select(F.col("doc").alias("doi"))))
query(
    "corpus_delta",
    f"""WITH {S.normal_form('candidates', 'row_id', 'title', 'nt', True)}, b AS (SELECT DISTINCT {S.title('t')} AS t FROM nt WHERE {S.title('t')} <> ''), n AS (SELECT DISTINCT {S.title('t')} AS t FROM nt JOIN candidates USING (row_id) WHERE {S.title('t')} <> '' AND source IN ('pubmed', 'eric'))
SELECT count(b.t) AS broad_n, count(n.t) AS narrow_n, count(*) FILTER (WHERE n.t IS NULL) AS delta_n, count(*) FILTER (WHERE b.t IS NULL) AS outside_n FROM b FULL JOIN n ON b.t = n.t""",
)(
    lambda s, d: cr.corpus_delta(
        _c(s, d).select(X.normalize_title("title").alias("t")).filter("t <> ''"), _c(s, d).filter(F.col("source").isin("pubmed", "eric")).select(X.normalize_title("title").alias("t")).filter("t <> ''"), "t"
    )
)
query(
    "metadata_criteria",
    rf"""SELECT row_id, CASE WHEN NOT regexp_full_match({S.strip("coalesce(year, '')")}, '\d{{4}}') THEN 'not_reported' WHEN CAST({S.strip('year')} AS INTEGER) > 2020 THEN 'met' ELSE 'not_met' END AS recency FROM candidates""",
)(lambda s, d: _c(s, d).select("row_id", cr.recency_status(F.col("year")).alias("recency")))
query(
    "language_criteria",
    f"""SELECT doc_id, CASE WHEN lower({S.strip("coalesce(lang, '')")}) = '' THEN 'not_reported' WHEN lower({S.strip('lang')}) IN ('en', 'eng', 'english') THEN 'met' ELSE 'not_met' END AS status FROM documents""",
)(lambda s, d: table(s, d, "documents").select("doc_id", cr.language_status(F.col("lang")).alias("status")))
