"""Queries over recorded answers of sources and over full texts, and their SQL.

The answers are written from the candidates in the format of each source; what must come out follows from the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.functions import udfs as U
from reviewlake.operators import fulltext, screening, stages
from reviewlake.plans import sqltext as S
from reviewlake.session import table

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


def _xml(value: Column) -> Column:
    """Text of an XML element; characters that XML does not allow are left out."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(ch), F.lit(entity))
    return out


def _flat(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffe}}\x{{ffff}}]', '', 'g'), '{S.SPACES}', ' ', 'g'))"


def _c(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "candidates")


@query(
    "pubmed_records",
    rf"""SELECT row_id, {_flat('title')} AS title, CASE WHEN row_id % 3 = 2 THEN '' ELSE '10.1000/' || row_id END AS doi, 'https://pubmed.ncbi.nlm.nih.gov/' || row_id || '/' AS source_id,
  ['2019', '2021', '2005'][row_id % 3 + 1] AS year, trim({_flat('abstract')} || ' ' || 'end') AS abstract, CASE WHEN row_id % 2 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || row_id || '/' ELSE '' END AS oa_url FROM candidates WHERE row_id % 7 <> 0""",
)
def _pubmed(s: SparkSession, d: str) -> DataFrame:
    """Articles with the DOI in their own list, in a location, or only in a reference; years in three places; PMC numbers with and without prefix; every seventh without PMID."""
    n, no = F.col("row_id"), F.col("row_id").cast("string")
    year = F.when(n % 3 == 0, "<PubDate><MedlineDate>2019 Spring</MedlineDate></PubDate>").when(n % 3 == 1, "<PubDate><Year>2021</Year></PubDate>").otherwise("<PubDate><Season>Spring</Season></PubDate>")
    history = F.when(n % 3 == 2, "<History><PubMedPubDate PubStatus='received'><Year>1999</Year></PubMedPubDate><PubMedPubDate PubStatus='EPublish'><Year>2005</Year></PubMedPubDate></History>").otherwise("")
    ids = F.concat(
        F.when(n % 3 == 0, F.concat(F.lit("<ArticleId IdType='doi'>https://doi.org/10.1000/"), no, F.lit("</ArticleId>"))).otherwise(""),
        F.when(n % 4 == 0, F.concat(F.lit("<ArticleId IdType='pmc'>PMC"), no, F.lit("</ArticleId>"))).when(n % 4 == 2, F.concat(F.lit("<ArticleId IdType='pmcid'>"), no, F.lit("</ArticleId>"))).otherwise(""),
    )
    where = F.when(n % 3 == 1, F.concat(F.lit("<ELocationID EIdType='pii'>x</ELocationID><ELocationID EIdType='doi'>10.1000/"), no, F.lit("</ELocationID>"))).otherwise("")
    xml = F.concat(
        F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation>"), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("<PMID>"), no, F.lit("</PMID>"))), F.lit("<Article><Journal><JournalIssue>"), year, F.lit("</JournalIssue></Journal><ArticleTitle>"),
        _xml(F.col("title")), F.lit("</ArticleTitle>"), where, F.lit("<Abstract><AbstractText Label='AIM'>"), _xml(F.col("abstract")), F.lit("</AbstractText><AbstractText>end</AbstractText></Abstract></Article></MedlineCitation><PubmedData>"), history, F.lit("<ArticleIdList>"), ids,
        F.lit("</ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType='doi'>10.9/ref</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle></PubmedArticleSet>"),
    )
    return _c(s, d).select("row_id", F.explode(U.parse_pubmed(xml)).alias("r")).select("row_id", "r.*")


_CLEAN = rf"trim(regexp_replace(coalesce({{}}, ''), '{S.SPACES}', ' ', 'g'))"


@query(
    "eric_records",
    rf"""SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'A; B' ELSE 'T & x ' || row_id END AS title, CASE row_id % 3 WHEN 0 THEN '10.1000/' || row_id WHEN 1 THEN '10.2000/' || row_id ELSE '' END AS doi, 'https://eric.ed.gov/?id=EJ%20' || row_id AS source_id,
  '2020-01' AS year, 'An abstract' AS abstract, CASE row_id % 3 WHEN 1 THEN 'https://x.example/10.2000/' || row_id WHEN 2 THEN 'http://y.example/' || row_id ELSE '' END AS oa_url, 'N, A; M, B' AS authors, 'Report' AS publication_type, 'S1; S2' AS subjects FROM candidates WHERE row_id % 5 <> 0""",
)
def _eric(s: SparkSession, d: str) -> DataFrame:
    """Notices with other names of their fields, lists, nested names, entities and tags; every fifth page has a notice without id."""
    n, no = F.col("row_id"), F.col("row_id").cast("string")
    ident = F.when(n % 5 == 0, "").otherwise(F.concat(F.when(n % 2 == 0, '"ERICID":"').otherwise('"id":"'), F.lit("EJ "), no, F.lit('",')))
    title = F.when(n % 2 == 0, '"title":["A","","B"],').otherwise(F.concat(F.lit('"title":"","Title":"<i>T</i> &amp; x '), no, F.lit('",')))
    link = F.when(n % 3 == 0, F.concat(F.lit('"doi":"doi:10.1000/'), no, F.lit('.).",'))).when(n % 3 == 1, F.concat(F.lit('"url":["none","https://x.example/10.2000/'), no, F.lit('"],'))).otherwise(F.concat(F.lit('"e_fulltext":"http://y.example/'), no, F.lit('",')))
    page = F.concat(F.lit('{"response":{"numFound":1,"docs":[{'), ident, title, link, F.lit('"publicationDateYear":"2020-01","description":{"value":"An <b>abstract</b>"},"author":["N, A",{"name":"M, B"}],"publicationtype":"Report","subject":["S1","S2"]}]}}'))
    got = _c(s, d).select("row_id", U.parse_notice_page(page).alias("p")).filter("p.valid")
    return got.select("row_id", F.explode("p.records").alias("r")).select("row_id", "r.*")


@query("esearch_counts", "SELECT row_id, CASE WHEN row_id % 4 = 3 THEN NULL ELSE row_id END AS count, CASE WHEN row_id % 4 = 2 THEN 'w2' WHEN row_id % 4 = 3 THEN '' ELSE 'w' END AS webenv, CASE WHEN row_id % 4 = 3 THEN '' ELSE '1' END AS query_key FROM candidates")
def _esearch(s: SparkSession, d: str) -> DataFrame:
    """Answers in both formats, with other cases of the names, and with a truth value for the count."""
    n, no = F.col("row_id"), F.col("row_id").cast("string")
    answer = (
        F.when(n % 4 == 0, F.concat(F.lit('{"esearchresult":{"count":"'), no, F.lit('","webenv":"w","querykey":"1"}}'))).when(n % 4 == 1, F.concat(F.lit('{"esearchresult":{"Count":'), no, F.lit(',"WebEnv":"w","query_key":1}}')))
        .when(n % 4 == 2, F.concat(F.lit(" <R xmlns='urn:x'><Count> "), no, F.lit("</Count><WebEnv>w2</WebEnv><QueryKey>1</QueryKey></R>"))).otherwise('{"esearchresult":{"count":true}}')
    )
    return _c(s, d).select("row_id", U.parse_esearch(answer).alias("r")).select("row_id", "r.*")


@query("jats_markdown", rf"""SELECT row_id, '10.1000/' || row_id AS doi, 'PMC' || row_id AS pmcid, 'Title ' || row_id AS title, '# Title ' || row_id || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || 'Short text.' || chr(10) || chr(10) || '## Methods' || chr(10) || chr(10) || repeat('word ', 120) || row_id || chr(10) || chr(10)
  || 'boxed' || chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || '- one' || chr(10) || chr(10) || '- two' || chr(10) AS markdown FROM candidates""")
def _jats(s: SparkSession, d: str) -> DataFrame:
    """Articles with sections in sections, boxes, lists, a line twice, and a reference with a title and a DOI of its own."""
    no = F.col("row_id").cast("string")
    body = F.concat(F.lit("<body><sec><title>Methods</title><p>"), F.repeat(F.lit("word "), 120), no, F.lit("</p><boxed-text><p>boxed</p><p>boxed</p></boxed-text><sec><label>2</label><title>Deep</title><list><list-item><p>one</p></list-item><list-item><p>two</p></list-item></list></sec></sec></body>"))
    xml = F.concat(F.lit("<set><article><front><article-meta><article-id pub-id-type='doi'>10.1000/"), no, F.lit("</article-id><article-id pub-id-type='pmc'>PMC"), no, F.lit("</article-id><title-group><article-title>Title "), no, F.lit("</article-title></title-group><abstract><p>Short  text.</p></abstract></article-meta></front>"), body, F.lit("<back><ref-list><ref><article-title>Other</article-title></ref></ref-list></back></article></set>"))
    return _c(s, d).select("row_id", F.explode(U.parse_jats(xml)).alias("r")).select("row_id", "r.doi", "r.pmcid", "r.title", "r.markdown")


_DOI = r"regexp_replace(regexp_replace(lower({0}), '^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*', ''), '[ .]+$', '')".format(S.strip("coalesce(doi, '')"))


@query(
    "pmc_identity",
    f"""WITH {S.normal_form('candidates', 'row_id', 'title', 'n', True)}, t AS (SELECT row_id, trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS t FROM n), x AS (SELECT c.row_id, {_DOI} AS d, t.t FROM candidates c JOIN t USING (row_id))
SELECT row_id, CASE row_id % 4 WHEN 0 THEN CASE WHEN d <> '' THEN 'doi' WHEN t = '' THEN 'no_title' ELSE 'title' END WHEN 1 THEN CASE WHEN d <> '' THEN 'doi_differs' WHEN t = '' THEN 'no_title' ELSE 'title' END
  WHEN 2 THEN CASE WHEN t = '' THEN 'no_title' ELSE 'title' END ELSE CASE WHEN t = '' THEN 'no_title' ELSE 'title_differs' END END AS verdict FROM x""",
)
def _pmc_identity(s: SparkSession, d: str) -> DataFrame:
    """Articles with the candidate's DOI, another DOI, no DOI, and no DOI with another title."""
    n = F.col("row_id")
    doi = F.when(n % 4 == 0, F.concat(F.lit(" "), F.upper(X.normalize_identity_doi("doi")), F.lit("."))).when(n % 4 == 1, "10.9999/other").otherwise("")
    title = F.when(n % 4 == 3, "something else").otherwise(F.concat(F.lit("“"), F.coalesce("title", F.lit("")), F.lit("” ")))
    return _c(s, d).select("row_id", fulltext.pmc_identity(doi, title, F.col("doi"), F.col("title")).alias("verdict"))


@query(
    "open_copy_answers",
    """SELECT row_id, ['', 'unpaywall_identity_mismatch', 'unpaywall_doi_unknown', 'unpaywall_api_http_500', 'unpaywall_api_invalid_response', 'unpaywall_no_open_copy', 'unpaywall_doi_absent'][row_id % 7 + 1] AS reason,
  CASE WHEN row_id % 7 = 0 THEN 'https://a.example/' || row_id || '.pdf http://b.example/' ELSE '' END AS urls FROM candidates""",
)
def _open_copies(s: SparkSession, d: str) -> DataFrame:
    """Answers of an open-access index of every kind."""
    k, no = F.col("row_id") % 7, F.col("row_id").cast("string")
    good = F.concat(F.lit('{"doi":"HTTPS://doi.org/10.1000/'), no, F.lit('","best_oa_location":{"url_for_pdf":" https://a.example/'), no, F.lit('.pdf","url":"ftp://c"},"oa_locations":[null,{"url_for_pdf":"https://a.example/'), no, F.lit('.pdf","url":"http://b.example/"}]}'))
    text = F.when(k == 0, good).when(k == 1, '{"doi":"10.1000/x"}').when(k == 4, "[").when(k == 5, F.concat(F.lit('{"doi":"10.1000/'), no, F.lit('","oa_locations":null}'))).otherwise("")
    code = F.when(k == 2, 404).when(k == 3, 500).otherwise(200)
    doi = F.when(k == 6, "").otherwise(F.concat(F.lit("10.1000/"), no))
    return _c(s, d).select("row_id", fulltext.read_index_answers(doi, code, text).alias("r")).select("row_id", "r.reason", F.array_join("r.urls", " ").alias("urls"))


@query(
    "fulltext_tiers",
    """SELECT CAST(row_id AS VARCHAR) AS doc, CASE WHEN row_id % 8 IN (5, 7) THEN 'retrieval_failed' ELSE 'retrieved' END AS decision,
  ['cache', 'pmc', 'pmc', 'open_copy', 'dropzone', 'identity_conflict', 'index', 'none'][row_id % 8 + 1] AS tier, CASE WHEN row_id % 8 IN (5, 7) THEN NULL ELSE 600 + row_id % 8 END AS n FROM candidates""",
)
def _tiers(s: SparkSession, d: str) -> DataFrame:
    """Articles that each tier serves, with later tiers filled too: a cache of another article, an identity conflict, a text that is too short."""
    k, no = F.col("row_id") % 8, F.col("row_id").cast("string")
    long = F.rpad(F.lit("text "), 600, "x")
    padded = F.concat(long, F.repeat(F.lit("y"), k.cast("int")))
    none = F.lit(None).cast("string")
    pmc = k.isin(0, 1, 2, 5)
    rows = _c(s, d).select(
        no.alias("doc"), F.concat(F.lit("10.1000/"), no).alias("doi"), F.concat(F.lit("Title "), no).alias("title"), F.when(pmc, F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), no, F.lit("/"))).otherwise("https://x.example/a.pdf").alias("oa_url"),
        F.when(k == 0, F.concat(F.rpad(F.concat(F.lit("# title "), no, F.lit("\n")), 600, "x"), F.lit(""))).when(k == 2, F.concat(F.lit("# Other\n"), long)).alias("cached"),
        F.when(k.isin(1, 2), F.concat(F.lit("10.1000/"), no)).when(k == 5, "10.1000/other").alias("pmc_doi"), F.when(k.isin(1, 2, 5), F.concat(F.lit("Title "), no)).alias("pmc_title"), F.when(k.isin(1, 2, 5), padded).alias("pmc_markdown"),
        F.when(k == 3, padded).when(k == 4, "short").alias("oa_text"), F.when(k.isin(3, 4, 5), padded).alias("drop_text"), F.when(k.isin(6, 7), F.concat(F.lit("10.1000/"), no)).alias("index_doi"),
        F.when(k == 6, F.concat(F.rpad(F.concat(F.lit("see 10.1000 /"), no, F.lit(" ")), 600, "x"), F.repeat(F.lit("y"), k.cast("int")))).when(k == 7, F.concat(F.rpad(F.concat(F.lit("see 10.1000/"), no, F.lit("9 ")), 600, "x"), F.lit("y"))).otherwise(none).alias("index_text"),
    )
    return fulltext.retrieve(rows).select("doc", "decision", "tier", F.length("content").cast("long").alias("n"))


@query(
    "query_contracts",
    """SELECT row_id, ['', 'missing search', 'unknown max_results,unknown sort', 'query_mode must be search', 'search must be a non-blank string', 'query must be an object', 'filter must be a non-blank string', 'missing query_mode'][row_id % 8 + 1] AS errors FROM candidates""",
)
def _contracts(s: SparkSession, d: str) -> DataFrame:
    """Structured queries with every fault."""
    texts = ('{"query_mode":"search","search":"a","filter":"f"}', '{"query_mode":"search"}', '{"query_mode":"search","search":"a","sort":"s","max_results":3}', '{"query_mode":"eric","search":"a"}', '{"query_mode":"search","search":"  "}', '"text"', '{"query_mode":"search","search":"a","filter":7}', '{"search":"a"}')
    return _c(s, d).select("row_id", F.array_join(screening.query_contract_errors(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("row_id") % 8 + 1).cast("int")), "openalex"), ",").alias("errors"))


@query(
    "cells_settled",
    """SELECT row_id, ['value', 'NON TROUVÉ', 'ERREUR API', 'CITATION REJETÉE', 'second', 'CITATION REJETÉE'][row_id % 6 + 1] AS valeur, ['the  quick fox', '', '', '', 'lazy dog ' || row_id, ''][row_id % 6 + 1] AS citation,
  ['extracted', 'not_found', 'api_error', 'rejected_citation', 'extracted', 'rejected_citation'][row_id % 6 + 1] AS outcome, row_id % 6 IN (4, 5) AS retried FROM candidates""",
)
def _settled(s: SparkSession, d: str) -> DataFrame:
    """Cells with a citation in the text, without value, failed, with a paraphrase, rescued by a retry, and not rescued because only the fourth citation would do."""
    k, no = F.col("row_id") % 6, F.col("row_id").cast("string")
    body = F.concat(F.lit("The text: the quick\nfox and a lazy dog "), no, F.lit("."))
    quotes = F.when(k == 4, F.array(F.lit("nowhere"), F.concat(F.lit("lazy dog "), no), F.lit("fox"))).when(k == 5, F.array(F.lit("a1"), F.lit("a2"), F.lit("a3"), F.lit("fox")))
    cells = _c(s, d).select(
        "row_id", F.when(k == 1, "NON TROUVÉ").when(k == 2, "ERREUR API").otherwise("value").alias("valeur"), F.when(k == 0, "the  quick fox").when(k.isin(1, 2), "").otherwise("a paraphrase").alias("citation"), F.when(k.isin(4, 5), "second").alias("retry_valeur"), quotes.alias("retry_citations"), body.alias("body")
    )
    return stages.settle_cells(cells)


@query(
    "review_applied",
    f"""WITH q AS (SELECT seq AS place, k AS identity_type, d AS doc FROM (SELECT k, d, max(seq) AS seq FROM (SELECT *, {S.KIND} AS k, {S.nb('doc')} AS d FROM decisions) WHERE d IS NOT NULL AND stage = 'screen_title_abstract' AND {S.KNOWN} GROUP BY k, d HAVING max_by(decision, seq) = 'needs_manual')),
h AS (SELECT doc, max_by(decision, seq) AS last FROM decisions WHERE stage IN ('human_review', 'screen_manual') AND decision IN ('include', 'exclude') AND {S.nb('doc')} IS NOT NULL GROUP BY doc)
SELECT q.identity_type, q.doc, CASE WHEN place % 2 = 0 THEN 'include' ELSE 'exclude' END AS decision FROM q LEFT JOIN h USING (doc) WHERE place % 3 <> 0 AND q.doc IN (SELECT doc FROM q GROUP BY doc HAVING count(*) = 1) AND coalesce(last, '') <> CASE WHEN place % 2 = 0 THEN 'include' ELSE 'exclude' END""",
)
def _review(s: SparkSession, d: str) -> DataFrame:
    """Decisions on two of three open cases, by identity or by place, of which those that repeat the journal add nothing."""
    from reviewlake.operators import journal
    from reviewlake.session import cut

    lines = table(s, d, "decisions")
    last = journal.entries(lines).filter("stage = 'screen_title_abstract'").groupBy("identity_type", "doc").agg(F.max(F.struct("seq", "decision", "score")).alias("x")).filter("x.decision = 'needs_manual'")
    # A case is numbered by the line that asked for a human.
    queue = last.select("identity_type", "doc", "x.score", F.col("x.seq").alias("place"))
    alone = queue.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("doc")
    blank = F.lit(None).cast("string")
    queue = cut(queue.select("place", "identity_type", "doc", "score", blank.alias("doi"), blank.alias("source_id"), blank.alias("oa_url"), F.lit("").alias("reason")))
    asked = queue.filter(F.col("place") % 3 != 0).join(alone, "doc", "left_semi")
    decisions = asked.select(F.col("place").cast("long").alias("seq"), F.when(F.col("place") % 5 == 0, F.col("place").cast("string")).otherwise(F.col("doc")).alias("key"), F.when(F.col("place") % 2 == 0, "include").otherwise("exclude").alias("decision"))
    new, _, _ = stages.apply_decisions(queue, decisions, lines)
    return new.select("identity_type", "doc", "decision")


query(
    "user_messages",
    """SELECT row_id, concat_ws(chr(10), '<DOCUMENT>', 'T: Case ' || row_id || ' <DOC>', 'S1: First </DOC> sentence.', 'S2: Second i.e. one, etc. more.', '</DOCUMENT>') AS message FROM candidates""",
)(lambda s, d: _c(s, d).select("row_id", X.user_message(F.concat(F.lit("Case "), F.col("row_id").cast("string"), F.lit(" <DOCUMENT>")), X.sentence_records(F.lit("First </DOCUMENT> sentence. Second i.e. one, etc. more."))).alias("message")))
