import json
import os

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.functions import udfs as U
from reviewlake.operators import dedup, extraction, screening, stages
from reviewlake.sources import files, sinks

CAND = "row_id long, title string, doi string, source_id string, year string, abstract string, oa_url string, source string, date string"


def test_search_puts_sources_together_with_their_states(spark):
    works = {"meta": {"count": 1}, "results": [{"title": "T", "doi": "https://doi.org/10.1/a", "id": "W1", "publication_year": 2020}]}
    plan = {"openalex": {"query_mode": "search", "search": "x"}, "eric": {"query_mode": "eric", "search": " "}, "scopus": {}}
    files_ = spark.createDataFrame([("10.1/a",)], "doi string")
    rows, meta = stages.search(spark, plan, {"openalex": lambda p: (200, json.dumps(works))}, "2024-05-01", files_)
    r = rows.first()
    assert (r["title"], r["source"], r["pdf_status"], r["query"], r["date"]) == ("T", "openalex", "dropzone", '{"query_mode":"search","search":"x"}', "2024-05-01")
    assert {m["source"]: (m["retrieved"], m["status"]) for m in meta.collect()} == {"openalex": (1, "complete"), "eric": (0, "error"), "scopus": (0, "error")}
    manifest = stages.search_manifest("r", plan, meta, "now")
    assert manifest["search_status"] == "error" and manifest["search_meta"]["openalex"]["endpoint"].startswith("https://")
    none, _ = stages.search(spark, {}, {}, "2024-05-01")
    assert none.count() == 0
    with pytest.raises(RuntimeError):
        screening.check_search_complete(manifest["search_status"])


def test_merge_with_log_and_rates(spark):
    rows = [
        ("A study of sleep in nurses", "10.1/a", None, "2020", "p"), ("Other words", "10.1/a", "s1", "2021", "q"), ("Memory training for carers", None, "s2", "2019", "p"), ("MEMORY training, for carers", None, "s3", "2020", None),
        ("Reading aloud at home with children", "10.2/b", None, "2018", "q"), ("Reading aloud at home with childrens", None, "s5", "2018", "q"), ("Alone", None, "s6", None, "q"),
    ]
    df = spark.createDataFrame([(i + 1, t, d, s, y, None, None, src, "2024-01-01") for i, (t, d, s, y, src) in enumerate(rows)], CAND)
    kept, log, rates = stages.merge(df)
    assert sorted(r["row_id"] for r in kept.collect()) == [2, 4, 5, 7]
    by = {r["pass"]: r for r in log.collect()}
    assert by["identity"]["reason"] == "identité exacte (doi, source_id) — 2 copies fusionnées (sources: p, q)" and by["identity"]["score"] == 1.0
    assert by["title"]["reason"] == "titre normalisé identique — 2 versions fusionnées (années compatibles; sources: ?, p)"
    assert by["similar"]["score"] == 0.986 and by["similar"]["reason"].startswith("titre similaire (ratio=0.986, seuil=0.900; années compatibles")
    assert {r["source"]: (r["records"], r["merged"], r["alarm"]) for r in rates.collect()}["p"] == (2, 1, True)
    with pytest.raises(ValueError, match="8"):
        stages.merge(df.unionByName(spark.createDataFrame([(8, "No id", " ", None, None, None, None, "p", None)], CAND)))


def test_similar_titles_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    words = "sleep memory nurses carers trial home reading".split()
    rows = []
    for i in range(150):
        t = " ".join(rnd.choice(words) for _ in range(5))
        rows.append((i, t if rnd.random() < 0.5 or not rows else rows[rnd.randrange(len(rows))][1] + rnd.choice(["s", "", " x"]), None, None, rnd.choice(["2019", "2020", "2022", None]), None, None, "p", None))
    df = spark.createDataFrame(rows, CAND)
    reps = {}
    for r in rows:
        reps.setdefault((U.normalize_title_text(r[1]), r[4]), r[0])
    want = set()
    for (t1, y1), k1 in reps.items():
        for (t2, y2), k2 in reps.items():
            if k1 < k2 and (y1 is None or y2 is None or abs(int(y1) - int(y2)) <= 1) and U.ratio(t2, t1) >= 0.9:
                want.add((k1, k2))
    assert {(r["a"], r["b"]) for r in dedup.similar_title_pairs(df).collect()} == want and want


def test_review_is_idempotent(spark):
    queue = spark.createDataFrame([(1, "d1", "doi", None, None, None, "0.5", ""), (2, None, None, None, "s2", None, "0.4", ""), (3, None, None, None, None, None, "0.4", "")], "place int, doc string, identity_type string, doi string, source_id string, oa_url string, score string, reason string")
    asked = spark.createDataFrame([(1, "d1", "include"), (2, "2", "exclude"), (3, "3", "include"), (4, "9", "include"), (5, "d1", "perhaps"), (6, "d1", "include")], "seq long, key string, decision string")
    history = spark.createDataFrame([], "seq long, doc string, stage string, decision string")
    new, remaining, refused = stages.apply_decisions(queue, asked, history)
    lines = {(r["doc"], r["identity_type"], r["decision"]) for r in new.collect()}
    assert lines == {("d1", "doi", "include"), ("s2", "source_id", "exclude")} and [r["place"] for r in remaining.collect()] == [3]
    assert {(r["seq"], r["refused"]) for r in refused.collect()} == {(3, "no_identity"), (4, "unknown_case"), (5, "invalid_decision")}
    again, _, _ = stages.apply_decisions(queue, asked, new.select("seq", "doc", "stage", "decision"))
    assert again.count() == 0


def test_plug_ins_and_gate(spark):
    grid = extraction.grid(spark.createDataFrame([("doi", "d1")], "identity_type string, doc string"), ("population", "design"))
    cells = spark.createDataFrame([("d1", "design", "RCT", "a trial", "Methods", None, None)], "doc string, variable string, valeur string, citation string, section string, retry_valeur string, retry_citations array<string>")
    got = stages.settle_cells(stages.recorded_extractor(cells)(grid).withColumn("body", F.lit("it was a trial")))
    assert {(r["variable"], r["outcome"], r["section"]) for r in got.collect()} == {("design", "extracted", "Methods"), ("population", "api_error", None)}
    scores = spark.createDataFrame([("d1", 0.8, "fits", "m")], "doc string, score double, reason string, model_served string")
    routed = stages.recorded_scorer(scores)(spark.createDataFrame([("d1",), ("d2",)], "doc string")).select("doc", X.decide("score").alias("r"))
    assert {(r["doc"], r["r"]) for r in routed.collect()} == {("d1", "include"), ("d2", "needs_manual")}
    docs, final = spark.createDataFrame([("doi", "d1")], "identity_type string, doc string"), spark.createDataFrame([("doi", "d1", "needs_manual")], "identity_type string, doc string, decision string")
    stages.extraction_gate(docs, final, False)
    with pytest.raises(RuntimeError, match="d1"):
        stages.extraction_gate(docs, final, True)
    with pytest.raises(RuntimeError):
        extraction.report_gate(0, 5, 2, 3)


def test_sinks_round_trip(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    queue = spark.createDataFrame([("a", 1), ("b", 2)], "doc string, n int")
    sinks.write_queue(queue, at("q"))
    sinks.write_queue(spark.read.json(at("q")).filter("n > 1"), at("q"))
    assert [r["doc"] for r in spark.read.json(at("q")).collect()] == ["b"]
    cell = ("10.1/a", "", "", "10.1/a", "doi", "v", 'a "x", b', "c\nd", "s")
    df = spark.createDataFrame([cell], ", ".join(f"{c} string" for c in sinks.EXTRACTION))
    assert sinks.write_extraction(df, at("e5")) == sinks.EXTRACTION_DOI and sinks.write_extraction(df.withColumn("identity_type", F.lit("oa_url")), at("e9")) == sinks.EXTRACTION
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(at("e5")).first()
    assert (back["valeur"], back["citation"]) == ('a "x", b', "c\nd")
    sinks.write_markdown(spark.createDataFrame([("doi", "10.1/a", "text\r\n"), ("oa_url", "http://x/y?z", None)], "identity_type string, doc string, text string"), at("md"))
    assert os.listdir(at("md")) == ["10.1_a.md"] and open(at("md") + "/10.1_a.md", newline="").read() == "text\r\n"
    assert files.read_texts(spark, at("md"), 3).count() == 1
    scores = spark.createDataFrame([("d", "include", "A", "none", 0.5, "include", True)], "doi string, label string, stratum string, abstract_source string, score double, decision string, api_error_flag boolean")
    assert sinks.write_scores(scores, at("s")).first()["score"] == 0.5
    assert sinks.upsert_manifest(at("m/manifest.json"), {"a": 1, "b": 2}) == {"a": 1, "b": 2} and sinks.upsert_manifest(at("m/manifest.json"), {"a": 3}, drop=("b",)) == {"a": 3}
    cand = spark.createDataFrame([tuple("x" if c == "title" else "" for c in files.CANDIDATE_COLUMNS)], files.CANDIDATES)
    files.write_candidates(cand, at("c"))
    assert sinks.snapshot(spark, at("c"), at("raw"), "dedup_done").count() == 1
    files.write_candidates(cand.unionByName(cand), at("c"))
    assert sinks.snapshot(spark, at("c"), at("raw"), "dedup_done").count() == 1 and sinks.snapshot(spark, at("c"), at("raw"), "search_done").count() == 2
    base = sinks.write_protocol({"id": "r1", "question": "Why?", "sources": [{"source": "eric", "reason": "r", "query": {"query_mode": "eric", "search": "x"}}], "criteria": ["adults"], "codebook": ["**design** : kind of study"]}, at("reviews"))
    text = spark.read.text(base + "/protocol.md", wholetext=True).select(F.lit(1).alias("doc_id"), F.col("value").alias("text"))
    assert screening.question_of(text).first()["question"] == "Why?" and screening.criteria_of(text).first()["criterion"] == "adults" and screening.codebook_of(text).first()["name"] == "design"
    with pytest.raises(ValueError):
        sinks.write_protocol({"id": "a/b"}, at("reviews"))
    sinks.write_lines(queue, at("l"))
    assert spark.read.json(at("l")).count() == 2
    run = sinks.run_manifest("r", "p", "c", ["1", "2"], ["m"], 2)
    assert run["expected_call_slots"] == 4
    sinks.check_digests({"p": "p"}, {"p": run["prompt_sha256"]})
    with pytest.raises(ValueError):
        sinks.check_digests({"p": "q"}, {"p": run["prompt_sha256"]})
    assert sinks.replace_once("abc", "b", "x") == "axc"
    with pytest.raises(ValueError):
        sinks.replace_once("abb", "b", "x")


def test_small_expressions(spark):
    one = spark.createDataFrame([(None, 5, 2), (3, 5, 2), (None, 1, 4)], "r int, a int, f int")
    assert [r[0] for r in one.select(X.recovered_texts(F.col("r"), F.col("a"), F.col("f"))).collect()] == [3, 3, 0]
    assert one.select(X.run_stamp(F.timestamp_micros(F.lit(1)))).first()[0] == "19700101T000000000001Z"
    assert spark.createDataFrame([("abcd", "abce")], "a string, b string").select(U.title_similarity("a", "b")).first()[0] == 0.75


def test_stream_ignores_replays_at_any_time(spark, tmp_path):
    from reviewlake.operators.journal import replayed_decisions
    from reviewlake.streaming import journal as st

    fields = [f.strip().split(" ")[0] for f in files.JOURNAL.split(", ")[:4]]
    assert fields[0] == "seq"
    rows = [(1, "d", "include"), (2, "d", "include"), (3, "d", "exclude"), (4, "d", "include"), (5, "e", "exclude"), (6, "d", "include")]
    for k, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"seq": s, "ts": f"2024-01-0{s}", "doc": d, "stage": "human_review", "decision": v}) for s, d, v in part))
    src = st.read_journal_stream(spark, str(tmp_path / "in"), 1)
    st.start(st.decision_changes(src), str(tmp_path / "out"), str(tmp_path / "cp"), mode="append").awaitTermination()
    got = {r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    replays = {r["seq"] for r in replayed_decisions(files.read_journal(spark, str(tmp_path / "in"))).collect()}
    assert got == {1, 3, 4, 5} and got | replays == {1, 2, 3, 4, 5, 6} and replays == {2, 6}


def test_files_reports_and_small_tools(spark, tmp_path):
    from reviewlake.operators import calibration, criteria
    from reviewlake.operators import report as rep
    from reviewlake.streaming import journal as st

    at = lambda n: str(tmp_path / n)
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "10.1_a_b.pdf").write_bytes(b"x")
    assert [r["doi"] for r in files.list_dropzone(spark, at("pdf")).collect()] == ["10.1/a_b"]
    (tmp_path / "as").mkdir()
    (tmp_path / "as" / "m1.jsonl").write_text('{"case_id": "c"}\n')
    assert files.read_assessments(spark, at("as"), "case_id string").first()["file_stem"] == "m1"
    (tmp_path / "f.txt").write_text("x")
    assert files.frozen(spark, at("f.txt"), sinks.digest("x")).first()["text"] == "x"
    with pytest.raises(ValueError):
        files.frozen(spark, at("f.txt"), "0")
    line = spark.createDataFrame([(1, "d", "odd", "include", "2024-01-01T00:00:00Z"), (2, "d", "human_review", "include", "2024-01-01T02:00:00Z")], "seq long, doc string, stage string, decision string, ts string")
    files.append_journal(line.limit(1), at("j"))
    files.append_journal(line.filter("seq = 2"), at("j"))
    assert files.read_journal(spark, at("j")).count() == 2
    stream = st.read_journal_stream(spark, at("j"))
    st.start(st.unknown_stream(stream), at("u"), at("cu")).awaitTermination()
    assert spark.read.parquet(at("u")).filter("lines = 1").first()["stage"] == "odd"
    st.start(st.windowed_counts(stream), at("w"), at("cw")).awaitTermination()
    assert spark.read.parquet(at("w")).agg(F.sum("lines")).first()[0] == 2
    assert "included: 3" in rep.mermaid({"identified": 9, "fulltext_screened": 4, "included_final": 3}) and "included: 3" not in rep.mermaid({"identified": 9})
    text = rep.report("R", {"identified": 1}, {"t": line.select("doc"), "none": line.limit(0)})
    assert "| doc |" in text and "(none)" in text and "- [ ] correct" in rep.checklist([{"case_id": "c", "quote": "q"}])
    rows = spark.createDataFrame([(1, "T", None, None, None, None)], "row_id long, title string, year string, doi string, oa_url string, abstract string")
    rep.write_ris(rows, at("ris"))
    assert [r[0] for r in spark.read.text(at("ris")).collect()] == ["TY  - JOUR", "TI  - T", "ER  - ", ""]
    low, high = criteria.wilson(8, 10)
    assert 0.4 < low < 0.8 < high < 1 and criteria.wilson(0, 0) == (0.0, 1.0)
    gold = spark.createDataFrame([("A",), ("A",), ("B",)], "stratum string")
    assert calibration.plan_weights(gold, {"A": (10, 2), "B": (5, 1)}) == {"A": 5.0, "B": 5.0}
    for plan in ({"A": (10, 2)}, {"A": (10, 3), "B": (5, 1)}, {"A": (1, 2), "B": (5, 1)}):
        with pytest.raises(ValueError):
            calibration.plan_weights(gold, plan)
