import json
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.functions import udfs as U
from reviewlake.operators import calibration, criteria, dedup, identity, journal, screening
from reviewlake.operators.orphans import find_orphans, journal_orphans
import numpy as np

from reviewlake.operators.packed import _arcs, _bucket, _lattice, _Model, _pieces, _viterbi, segment_values
from reviewlake.sources import connectors as con

CAND = "row_id long, title string, doi string, source_id string, year string, abstract string, oa_url string, source string, date string"


def cand(spark, rows):
    full = [(i + 1, *(r.get(k) for k in ("title", "doi", "source_id", "year", "abstract", "oa_url")), r.get("source", "s"), r.get("date", "2024-01-01")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CAND)


# ---- packed fields ----


def test_pieces_quotes_and_separators():
    assert _pieces('"A; B ""x""";C') == [('A; B "x"', True), ("C", False)]
    assert _pieces('["A, B", "C"]') == [("A, B", True), ("C", True)]
    assert _pieces('X, "A, B", Y') == [("X", False), ("A, B", True), ("Y", False)]
    assert _pieces("; ;|") == []
    assert _lattice("A and B")[0][0] == ["A", "B"]


def test_segment_values_learns_where_values_end(spark):
    rows = [("Students, Nursing; Sleep", None)] * 6 + [("Education, Higher; Sleep", "")] * 6 + [("Sleep,Students, Nursing,Education, Higher", " ")] * 2 + [("Sleep", ";;"), (None, None)]
    df = spark.createDataFrame([(i, a, b, "x") for i, (a, b) in enumerate(rows)], "id long, subjects string, authors string, field_name string").select("id", "subjects", "authors", "field_name")
    got = {}
    for r in segment_values(df, "id", ["subjects", "authors"]).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["item"])
    assert got[0] == ["Students, Nursing", "Sleep"]
    assert got[12] == ["Sleep", "Students, Nursing", "Education, Higher"]
    assert got[14] == ["Sleep"] and 15 not in got


@pytest.mark.parametrize("words", [3, 4, 11, 30])
def test_every_word_of_a_long_value_counts(words):
    names = [" ".join(f"{'ABCDEFGHIJ'[i]}a{'abcdefghijklmnopqrstuvwxyzabcdefgh'[k]}" for k in range(words)) for i in range(8)]
    arcs = {c: np.asarray(v) for c, v in _arcs("f", ", ".join(names)).items()}
    assert [(i, j) for _, i, j in _viterbi(arcs, None, _Model(1e5, {_bucket("f", names[0])[0]: 0.05}))] == [(i, i) for i in range(8)]


def test_a_value_of_nine_atoms_comes_out_whole(spark):
    nine = "Ash, Birch, Cedar, Elm, Fir, Larch, Oak, Pine, and Yew Society"
    rows = [f'"{nine}"; Sleep', f'Sleep; "{nine}"', f'"{nine}"; Memory'] * 3 + [f"Sleep, {nine}", "Sleep; Memory", "Memory; Sleep"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, subjects string")
    got = {(r["id"], r["pos"]): r["item"] for r in segment_values(df, "id", ["subjects"]).collect()}
    assert got[(9, 1)] == "Sleep" and got[(9, 2)] == nine


def test_segment_values_of_an_empty_table(spark):
    assert segment_values(spark.createDataFrame([], "id long, a string"), "id", ["a"]).count() == 0


# ---- orphans ----


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    parents = [(f"k{rnd.randrange(40)}", f"2024-01-{rnd.randrange(1, 28):02d}") for _ in range(60)]
    refs = [(i, f"k{rnd.choice([0, 0, 0, rnd.randrange(60)])}", f"2024-01-{rnd.randrange(1, 28):02d}") for i in range(300)]
    gone = {f"k{i}" for i in range(45, 52)}
    c = cand(spark, [{"doi": k, "date": d} for k, d in parents])
    w = spark.createDataFrame([("doi", k, "", "") for k in gone], "identity_type string, doc string, removed_on string, why string")
    r = spark.createDataFrame(refs, "ref_id long, key string, d string").select("ref_id", F.lit("doi").alias("kind"), "key", F.to_date("d").alias("ref_day"))
    got = {x["ref_id"]: x["verdict"] for x in find_orphans(r, c, w, ranges=3, batch_rows=50).collect()}
    first = {}
    for k, d in parents:
        first[k] = min(d, first.get(k, "9"))
    want = {}
    for i, k, d in refs:
        if k in first:
            if first[k] > d:
                want[i] = "late"
        else:
            want[i] = "deleted" if k in gone else "missing"
    assert got == want


def test_orphans_without_parents_and_with_blank_keys(spark):
    j = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", " ", None), (2, "bad", "10.1/x", ""), (3, None, None, "doi"), (4, "2024-01-01T00:00:00Z", "doi:", "doi")], "seq long, ts string, doc string, identity_type string")
    w = spark.createDataFrame([], "identity_type string, doc string, removed_on string, why string")
    assert {(r["seq"], r["kind"]) for r in journal_orphans(j, cand(spark, []).limit(0), w).collect()} == {(2, "missing"), (4, "missing")}


# ---- merging ----


def test_components_are_transitive_and_independent_of_order(spark):
    rows = [{"doi": "a", "source_id": "1"}, {"source_id": "2"}, {"doi": "a", "oa_url": "u"}, {"oa_url": "u", "source_id": "2"}, {}]
    got = {r["row_id"]: r["component"] for r in identity.connected_components(cand(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_long_chain_of_identities(spark):
    rows = [{"doi": f"d{i // 2}", "source_id": f"s{(i + 1) // 2}"} for i in range(24)]
    assert {r["component"] for r in identity.connected_components(cand(spark, rows)).collect()} == {1}


def kept(spark, rows):
    out = dedup.deduplicate(cand(spark, rows)).collect()
    return sorted(r["row_id"] for r in out)


def test_merge_scenarios(spark):
    same = "Identical title"
    assert kept(spark, [{"title": same, "source_id": "W1", "year": "2024"}, {"title": same, "source_id": "W2", "year": "2027"}]) == [1, 2]
    assert kept(spark, [{"title": "A", "source_id": "W1", "abstract": "long"}, {"title": "A", "source_id": "W1", "abstract": ""}]) == [1]
    assert kept(spark, [{"title": "X one", "doi": "10.1000/same"}, {"title": "Other thing", "doi": "10.1000/same", "abstract": "a"}]) == [2]
    assert kept(spark, [{"title": "Prompt engineering for reliable agents", "doi": "10.1/a", "year": "2024"}, {"title": "Prompt engineering for reliability agents", "source_id": "W", "year": "2025"}]) == [2]
    assert kept(spark, [{"title": "Prompt engineering for language model agents", "doi": "10.1/a"}, {"title": "Prompt engineering for language model agents s", "doi": "10.1/b"}]) == [1, 2]


def test_title_groups_against_first_fit(spark):
    rnd = random.Random(5)
    years = [rnd.choice(["2019", "2020", "2021", "2023", "", "n.d."]) for _ in range(60)]
    rows = [{"title": rnd.choice(["One", "two!"]), "source_id": str(i), "year": y} for i, y in enumerate(years)]
    got = {r["row_id"]: r["component"] for r in dedup.title_groups(cand(spark, rows)).collect()}
    groups, want = {}, {}
    for i, r in enumerate(rows, 1):
        y = int(r["year"]) if r["year"].isdigit() else None
        own = groups.setdefault(U.normalize_title_text(r["title"]), [])
        for g in own:
            if all(y is None or z is None or abs(y - z) <= 1 for _, z in g):
                g.append((i, y))
                break
        else:
            own.append([(i, y)])
    for own in groups.values():
        for g in own:
            for i, _ in g:
                want[i] = g[0][0]
    assert got == want


def test_similar_pairs_against_all_pairs(spark):
    rnd = random.Random(7)
    base = ["effect of coaching on reading in nurses", "effect of tutoring on reading in nurses", "sleep quality after training"]
    rows = []
    for i in range(40):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice("abc")
        rows.append({"title": "".join(t), "source_id": str(i), "year": rnd.choice(["2020", "2021", "2024", None])})
    got = {(r["a"], r["b"]) for r in dedup.similar_title_pairs(cand(spark, rows)).collect()}
    reps = {}
    for i, r in enumerate(rows, 1):
        reps.setdefault((U.normalize_title_text(r["title"]), r["year"]), i)
    want = set()
    for (t, y), i in reps.items():
        for (u, z), k in reps.items():
            if i < k and (y is None or z is None or abs(int(y) - int(z)) <= 1) and U.ratio(u, t) >= 0.9:
                want.add((i, k))
    assert got == want


# ---- journal ----

J = "seq long, doc string, identity_type string, stage string, decision string, score string, run string, model_served string"


def jrows(spark, rows):
    return spark.createDataFrame([(i + 1, d, None, s, x, sc, "run-2024-01-a", None) for i, (d, s, x, sc) in enumerate(rows)], J)


def test_human_outranks_machine_whatever_the_order(spark):
    j = jrows(spark, [("d", "human_review", "exclude", ""), ("d", "screen_title_abstract", "include", "0.9"), ("e", "screen_title_abstract", "include", "1"), ("e", "screen_title_abstract", "needs_manual", "0.5"), ("f", "nonsense", "include", ""), (" ", "human_review", "include", "")])
    got = {r["doc"]: (r["decision"], r["resolved_by"]) for r in journal.resolve_screening(j).collect()}
    assert got == {"d": ("exclude", "human"), "e": ("include", "machine")}
    assert [tuple(r) for r in journal.unknown_entries(j).collect()] == [("nonsense", "include", 1)]


def test_latest_fulltext_may_be_a_failure(spark):
    j = jrows(spark, [("d", "fulltext", "retrieved", ""), ("d", "fulltext", "retrieval_failed", ""), ("e", "fulltext", "retrieved", "")])
    assert [r["doc"] for r in journal.latest_fulltext(j).collect()] == ["e"]


def test_replays_across_blocks(spark):
    j = jrows(spark, [("d", "human_review", "include", "")] * 3 + [("d", "human_review", "exclude", "")])
    assert sorted(r["seq"] for r in journal.replayed_decisions(j, block=2).collect()) == [2, 3]


def test_stream_equals_batch(spark, tmp_path):
    from reviewlake.streaming.journal import read_journal_stream, resolve_screening_stream, start

    rnd = random.Random(1)
    lines = [{"seq": i, "doc": f"d{rnd.randrange(6)}", "stage": rnd.choice(["human_review", "screen_title_abstract", "fulltext"]), "decision": rnd.choice(["include", "exclude", "needs_manual"])} for i in range(1, 61)]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps(x) for x in lines[k * 20 : k * 20 + 20]))
    q = start(resolve_screening_stream(read_journal_stream(spark, str(src), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("doc").agg(F.max_by(F.struct("decision", "resolved_by", "decided_seq", "first_seq"), "batch").alias("x")).select("doc", "x.*")
    batch = journal.resolve_screening(spark.read.schema("seq long, doc string, identity_type string, stage string, decision string").json(str(src)))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in batch.select("doc", "decision", "resolved_by", "decided_seq", "first_seq").collect()}


# ---- measures and criteria ----


def test_golden_metrics(spark):
    gold = spark.createDataFrame([("include", 0.9)] * 11 + [("exclude", 0.8)] + [("include", 0.5)] + [("exclude", 0.1)] * 11, "label string, score double")
    r = calibration.confusion(gold).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (11, 1, 1, 11)
    assert (r["recall"], r["precision"], r["f1"], r["kappa"]) == (0.9167, 0.9167, 0.9167, 0.8333)


def test_metrics_of_nothing(spark):
    gold = spark.createDataFrame([], "label string, score double, stratum string")
    assert calibration.coverage(gold).first()["state"] == "failed"
    assert calibration.score_histogram(gold).count() == 20


def test_assessments_of_several_faults_and_replays():
    from reviewlake.operators import assessment as A

    sources = {"T": "A trial", "S1": "Some “quoted” text."}
    one = {"id": A.MODEL_CRITERIA[0], "status": "met", "evidence": [{"source": "S1", "quote": 'some "quoted"'}, {"source": "T", "quote": "~"}, {"source": ["x"], "quote": "a"}], "reason": ""}
    errors = A.assessment_errors({"schema": A.SCHEMA, "criteria": [one]}, sources, A.MODEL_CRITERIA[:1])
    assert errors == ["criteria[0].evidence[1].quote is empty after normalization", "criteria[0].evidence[2].source is invalid: ['x']", "criteria[0].reason is empty"]
    assert A.assessment_errors([], sources) == ["assessment must be an object"]
    with pytest.raises(A.AssessmentError, match="length"):
        A.served_content('{"choices": [{"finish_reason": "length"}]}')
    assert A.served_content('{"choices": [{"message": {"content": "{}"}}]}') == "{}"
    for bad in (None, "{}", "no json", '{"choices": [{"message": {}}]}'):
        with pytest.raises(A.AssessmentError):
            A.served_content(bad)
    old = {"schema": A.SCHEMA_V0, "criteria": [{"id": "x", "status": "met", "evidence": [{"source": "title", "quote": "A ... trial"}], "reason": "r"}]}
    assert A.replay_valid(json.dumps(old), {"title": "A ... Trial"}, ("x",), A.span_text) and not A.replay_valid(json.dumps(old), {"title": "A ... Trial"}, ("x",), A.spaced_text)


def test_guards_of_runs(spark):
    from reviewlake.operators import assessment as A

    df = spark.createDataFrame([("c1", "d", "t", "a", ""), ("c2", "d", "t", "a", "x")], "case_id string, doi string, title string, abstract string, label string")
    assert A.block_d_errors(df) == ["2 records instead of 5", "empty label"] and A.block_d_errors(df.drop("label")) == ["missing columns ['label']"]
    assert [r["case_id"] for r in A.frozen_block(df, ["c2", "c1"], "B").collect()] == ["c2", "c1"]
    with pytest.raises(ValueError, match="c9"):
        A.frozen_block(df, ["c9"], "B")
    assert A.check_allowlist(()) == frozenset()
    with pytest.raises(ValueError):
        A.check_allowlist(("E1",))
    assert {(r["bloc"], r["n"]) for r in A.blocks(A=df, B=df.limit(1)).groupBy("bloc").agg(F.count("case_id").alias("n")).collect()} == {("A", 2), ("B", 1)}
    v = spark.createDataFrame([(None, [], []), ("x", [], []), (None, None, []), (None, ["e"], [])], "t string, v array<string>, c array<string>").select(A.is_valid(F.col("t"), F.col("v"), F.col("c"))).collect()
    assert [r[0] for r in v] == [True, False, False, False]


# ---- functions and sources ----


def test_scalar_functions(spark):
    df = spark.createDataFrame([("It works, e.g. here. Next One. <b>x", "10.1000/AbC. ", "0.5x", "1.7", " 2020 ")], "t string, d string, bad string, s string, y string")
    r = df.select(F.size(X.segment_sentences("t")), X.normalize_identity_doi("d"), X.parse_score("bad"), X.parse_score("s"), X.parse_year("y"), X.decide(F.lit(0.75)), X.decide(F.lit(0.25))).first()
    assert list(r) == [3, "10.1000/abc", None, 1.0, 2020, "include", "exclude"]


ARTICLE = "<PubmedArticle xmlns='urn:x'><MedlineCitation><PMID>{pmid}</PMID><Article><ArticleTitle>T <i>x</i></ArticleTitle><ELocationID EIdType='doi'>10.1/e</ELocationID><Abstract><AbstractText Label='AIM'>A  b</AbstractText><AbstractText>c</AbstractText></Abstract><Journal><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList>{ids}</ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType='doi'>10.9/ref</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"


def test_pubmed_articles():
    one = ARTICLE.format(pmid=7, ids="<ArticleId IdType='doi'>https://doi.org/10.1/x</ArticleId><ArticleId IdType='pmcid'>5</ArticleId>")
    (r,) = U.pubmed_records(f"<Set>{one}{ARTICLE.format(pmid='', ids='')}</Set>")
    assert r == {"title": "T x", "doi": "10.1/x", "source_id": "https://pubmed.ncbi.nlm.nih.gov/7/", "year": "2019", "abstract": "A b c", "oa_url": "https://pmc.ncbi.nlm.nih.gov/articles/PMC5/"}
    assert U.pubmed_records(ARTICLE.format(pmid=8, ids="<ArticleId IdType='pmc'>PMC6</ArticleId>"))[0]["doi"] == "10.1/e"
    assert U.esearch_counts('{"esearchresult": {"count": "12", "webenv": "w", "querykey": 1}}') == (12, "w", "1")
    assert U.esearch_counts("<r><Count>3</Count><WebEnv>w</WebEnv><QueryKey>2</QueryKey></r>") == (3, "w", "2")
    assert U.esearch_counts('{"esearchresult": {"count": true}}')[0] is None


def test_jats_articles():
    import xml.etree.ElementTree as ET

    body = "<sec><title>A</title><label>1</label><p>{w}</p><boxed-text><p>in a box</p></boxed-text><disp-quote><p>quoted</p></disp-quote><fig><caption><p>wrapped</p></caption></fig><list><list-item><p>i1</p></list-item></list><sec><title>B</title><p>x</p><p>x</p></sec></sec>"
    head = "<front><article-meta><article-id pub-id-type='doi'>10.1/a</article-id><article-id pub-id-type='pmcid'>PMC9</article-id><title-group><article-title>T</article-title></title-group><abstract><title>Aim</title><p>one</p></abstract><abstract><p>two</p></abstract></article-meta></front>"
    xml = f"<article>{head}<body>{body.format(w='w ' * 300)}</body><back><ref-list><ref><article-title>Other</article-title><article-id pub-id-type='doi'>10.2/b</article-id></ref></ref-list></back></article>"
    article = ET.fromstring(xml)
    lines = U.jats_to_markdown(article).strip().split("\n\n")
    assert lines == ["# T", "## Abstract", "Aimone", "## Abstract", "two", "## A", ("w " * 300).strip(), "in a box", "quoted", "wrapped", "- i1", "### B", "x"]
    assert U.jats_to_markdown(article, 5000) is None and U.jats_ids(article) == {"doi": "10.1/a", "pmcid": "PMC9", "title": "T"}
    assert U.jats_to_markdown(ET.fromstring("<article/>")) is None and U.jats_ids(ET.fromstring("<article/>"))["title"] == ""


def test_retries_limits_and_states():
    waits, calls = [], []

    def flaky(params):
        calls.append(params)
        return (503, "") if len(calls) < 3 else (200, "ok")

    assert con.fetch(flaky, {}, waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(con.SearchIncomplete):
        con.fetch(lambda p: (503, ""), {}, waits.append)
    with pytest.raises(con.SearchError):
        con.fetch(lambda p: (404, ""), {}, waits.append)
    page = {"meta": {"count": 3}, "results": [{"title": "a", "publication_year": None, "open_access": None, "abstract_inverted_index": {"b": [1], "a": [0]}}]}
    rows, expected, state, _ = con.scan_works(lambda p: (200, json.dumps(page)), {"search": "x"}, limit=2)
    assert len(rows) == 2 and state == "capped" and rows[0]["abstract"] == "a b" and rows[0]["year"] == ""
    assert con.state_of(0, 0, 10) == ("complete", "zero_results")
    notice = {"response": {"numFound": 2, "docs": [{"title": ["A", "B"], "id": "EJ1", "url": ["no", "https://x.example/10.1234/ab."]}]}}
    rows, _, *state = con.scan_notices(lambda p: (200, json.dumps(notice if p["page"] == 1 else {"response": {"numFound": 3, "docs": []}})), {"search": "x"})
    assert state == ["incomplete", "count_changed"] and rows[0]["title"] == "A; B" and rows[0]["doi"] == "10.1234/ab" and rows[0]["oa_url"] == "https://x.example/10.1234/ab."
    assert con.scan_notices(lambda p: (200, '{"numFound": 1, "docs": [{"title": "no id"}]}'), {"search": "x"})[2:] == ("incomplete", "invalid_notice")


def articles(answers):
    """A transport over answers by step and batch."""
    return lambda p: (200, answers[p["step"]]) if p["step"] == "search" else answers.get(p["batch"], (503, ""))


def test_article_search_states():
    found = '{"esearchresult": {"count": "201", "webenv": "w", "querykey": "1"}}'
    batch = (200, "<S>" + "".join(ARTICLE.format(pmid=i, ids="") for i in range(1, 201)) + "</S>")
    last = (200, "<S>" + ARTICLE.format(pmid=201, ids="") + "</S>")
    quiet = {"sleep": lambda s: None, "email": "a@b.example"}
    query = {"query_mode": "pubmed", "term": "x"}
    assert [con.scan_articles(articles({"search": found, 1: batch, 2: last}), query, **quiet)[i] for i in (1, 2, 3)] == [201, "complete", ""]
    rows, expected, state, _ = con.scan_articles(articles({"search": found, 1: batch}), query, **quiet)
    assert (len(rows), expected, state) == (200, 201, "incomplete")
    assert con.scan_articles(articles({"search": found, 1: batch, 2: (200, "<S>")}), query, **quiet)[3] == "invalid_efetch_xml_batch_2"
    assert con.scan_articles(articles({"search": found, 1: batch}), query, limit=200, **quiet)[2] == "capped"
    assert con.scan_articles(lambda p: (404, ""), query, **quiet)[2] == "error" and con.scan_articles(lambda p: (200, ""), query)[3] == con.EMAIL_NEEDED
    assert con.scan_articles(articles({"search": '{"esearchresult": {"count": "0"}}'}), query, **quiet)[1:] == (0, "complete", "zero_results")
    # No more than three requests a second without a key, and no secret in a reason.
    slept = []
    limit = con.RateLimit(now=lambda: 0.0, sleep=slept.append)
    con.scan_articles(articles({"search": found, 1: batch, 2: last}), query, rate=limit, **quiet)
    assert len(slept) == 2 and all(abs(s - 1 / 3) < 1e-9 for s in slept)
    assert con.redact("a@b c a%40b", ["a@b"]) == "*** c ***"


def test_dispatch():
    with pytest.raises(NotImplementedError):
        con.search_source("scopus", {}, None)
    assert con.search_source("eric", {"query_mode": "eric", "search": " "}, None)[2] == "error"
    assert con.mcp_search("eric", {"query_mode": "eric", "search": "x", "sort": "year"}, lambda p: (200, '{"numFound": 0}'))[1:] == (0, "complete", "zero_results")
    assert con.mock_search("pubmed", {"query_mode": "pubmed", "term": "x"}, {"pubmed": [{"title": "T"}]}) == ([{"title": "T"}], 1, "complete", "mock")
    assert con.connector_metadata("x")["query_mode"] == "unknown" and con.connector_metadata("pubmed")["fetch_endpoint"]


def test_data_sources_read_recorded_answers_with_their_state(spark, tmp_path):
    (tmp_path / "page-1.json").write_text(json.dumps({"meta": {"count": 2}, "results": [{"title": "T", "doi": "https://doi.org/10.1/a", "id": "W1", "publication_year": 2020}]}))
    (tmp_path / "page-2.json").write_text(json.dumps({"meta": {"count": 2}, "results": []}))
    con.register(spark)
    rows = spark.read.format("works_pages").option("path", str(tmp_path)).option("query", '{"query_mode": "search", "search": "x"}').load().collect()
    assert [(r["title"], r["doi"], r["year"]) for r in rows if r["state"] is None] == [("T", "10.1/a", "2020")]
    assert [(r["expected"], r["state"]) for r in rows if r["state"]] == [(2, "incomplete")]
    (tmp_path / "page-1.json").write_text('{"response": {"numFound": 1, "docs": [{"id": "EJ 1", "title": "N"}]}}')
    rows = spark.read.format("notice_pages").option("path", str(tmp_path)).option("query", '{"query_mode": "eric", "search": "x"}').load().collect()
    assert rows[0]["source_id"] == "https://eric.ed.gov/?id=EJ%201" and rows[1]["state"] == "complete"


def test_contracts_and_guards(spark):
    assert screening.query_errors({"query_mode": "search", "search": "x"}, "openalex") == []
    assert screening.query_errors("x", "openalex") and screening.plan_errors([])
    assert screening.query_errors({"query_mode": "eric", "search": "x", "sort": "year"}, "eric") == [] and screening.query_errors({"query_mode": "search", "search": "x", "sort": "y"}, "openalex") == ["unknown sort"]
    assert screening.payload_errors({"id": "a b"}) and screening.payload_errors({"id": "a", "sources": [{"source": "eric", "reason": "r", "query": {"query_mode": "eric"}}]}) == []
    assert screening.prepared_query({"query_mode": "pubmed", "term": " x "}, "pubmed") == {"query_mode": "pubmed", "params": {"term": " x "}}
    given = [{"query_mode": "search", "search": "x"}, {"query_mode": "search", "search": " ", "sort": "y"}, {"query_mode": "eric"}, {"search": 3, "query_mode": "search", "filter": "f"}]
    df = spark.createDataFrame([(json.dumps(q),) for q in given] + [("no json",), ('"text"',), (None,)], "q string")
    got = [r[0] for r in df.select(screening.query_contract_errors(F.col("q"), "openalex")).collect()]
    assert got[:4] == [screening.query_errors(q, "openalex") for q in given] and got[4] == got[5] == ["query must be an object"] and got[6] is None
    with pytest.raises(ValueError):
        screening.check_thresholds(0.2, 0.5)
    st = spark.createDataFrame([("complete",), ("capped",), ("odd",)], "status string")
    assert screening.global_status(st).first()[0] == "error" and screening.global_status(st.limit(0)).first()[0] == "complete"


def test_block_joins_equal_plain_joins(spark):
    from reviewlake.operators.skew import join_blocks, join_hot

    rnd = random.Random(6)
    left = spark.createDataFrame([(i, 0 if rnd.random() < 0.4 else rnd.randrange(20)) for i in range(300)], "a long, k long")
    right = spark.createDataFrame([(i, 0 if rnd.random() < 0.4 else rnd.randrange(20)) for i in range(200)], "b long, k long")
    want = sorted((r["a"], r["b"]) for r in left.join(right, "k").collect())
    for most in (10, 1000, 10**9):
        assert sorted((r["a"], r["b"]) for r in join_blocks(left, right, "k", "a", "b", most).collect()) == want
    once = left.groupBy("k").agg(F.count("a").alias("n"))
    hot = join_hot(left, once, ["k"], "n", "a", 300.0, per_slice=7)
    assert hot.count() == 300 and join_hot(left.limit(0), once, ["k"], "n", "a", 0.0).count() == 0


def test_components_raise_when_rounds_run_out(spark):
    chain = [{"doi": f"d{i}", "source_id": f"d{i + 1}"} for i in range(40)]
    rows = cand(spark, [{"doi": c["doi"], "oa_url": None, "source_id": None} for c in chain] + [{"doi": c["doi"], "source_id": f"s{i}"} for i, c in enumerate(chain)] + [{"doi": f"d{i + 1}", "source_id": f"s{i}"} for i in range(39)])
    assert {r["component"] for r in identity.connected_components(rows).collect()} == {1}
    with pytest.raises(identity.NotConverged):
        identity.connected_components(rows, max_rounds=2)


def test_cut_tables_can_be_dropped(spark):
    import os

    from reviewlake.session import cut, forget

    df = cut(spark.range(3))
    path = df._cut_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 3
    forget(df)
    forget(df)
    assert not os.path.exists(path)


def test_cut_leaves_no_shuffle_files(spark):
    import glob
    import time

    from reviewlake.session import cut

    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in where for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    out = cut(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 10
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 7


def _common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for n, y in enumerate(b, 1):
            last, row[n] = row[n], last + 1 if x == y else max(row[n], row[n - 1])
    return row[-1]


def test_bounds_of_tiles_are_lossless():
    rnd = random.Random(11)
    base = ["effect of coaching on reading in nurses", "sleep quality after training " * 9, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "каталог a", "x"]

    def titles(n):
        out = []
        for _ in range(n):
            t = list(rnd.choice(base))
            for _ in range(rnd.randrange(1 + len(t) // 6)):
                t[rnd.randrange(len(t))] = rnd.choice("abcя ")
            out.append("".join(t))
        return out

    one, two = titles(60), titles(50)
    a, b = dedup.Tile(np.arange(60), one, np.full(60, np.nan)), dedup.Tile(np.arange(60, 110), two, np.full(50, 2020.0))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(50), indexing="ij"))
    slots = lambda t: [ord(c) % dedup.SLOTS for c in t]
    assert dedup._subsequences(a, b, i, j).tolist() == [_common_subsequence(slots(one[x]), slots(two[y])) for x, y in zip(i, j)]
    for threshold in (0.6, 0.9):
        want = {(x, 60 + y) for x in range(60) for y in range(50) if U.ratio(two[y], one[x]) >= threshold}
        assert {(x, y) for x, y, _ in dedup.similar_in_tiles(a, b, False, threshold)} == want and want


def test_tiles_are_not_shuffled_for_each_partner(spark, monkeypatch):
    """The comparison joins tiles without a shuffle of pairs of tiles, and small tiles give the same pairs."""
    rows = [{"title": f"effect of coaching on reading in group {i % 90} of nurses", "source_id": str(i), "year": str(2000 + i % 3)} for i in range(200)]
    plans = []
    real = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: (plans.append(df._jdf.queryExecution().toString()), real(df))[1])
    want = sorted(dedup.similar_title_pairs(cand(spark, rows)).collect())
    monkeypatch.setattr(dedup, "TILE", 5)
    monkeypatch.setattr(dedup, "PART_TILES", 7)
    assert sorted(dedup.similar_title_pairs(cand(spark, rows)).collect()) == want and want
    assert any("CartesianProduct" in p for p in plans)


def test_deduplicate_removes_the_table_of_the_first_pass(spark, monkeypatch):
    from reviewlake import session

    made, real = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: made.append(real(df)) or made[-1])
    out = dedup.deduplicate(cand(spark, [{"title": "A", "source_id": "W1"}, {"title": "A", "source_id": "W1"}, {"title": "B", "source_id": "W2"}]), fuzzy=False)
    first, second = [x._cut_path for x in made if "abstract" in x.columns]
    assert first not in session._WRITTEN and second in session._WRITTEN and out.count() == 2
