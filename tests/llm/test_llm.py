import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import abuse, chunks, formatting, linkage, packing, survivor, tokens, visual


def one_field(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id long, title string, field_name string").select("row_id", "title", "field_name")


# ---- visual form ----


def test_visual_cases_and_forms(spark):
    zw, nb, zwnj = chr(0x200B), chr(0xA0), chr(0x200C)
    texts = [
        "plain", "caf" + "e" + chr(0x301), f"wo{zw}rd", f"a{nb}b", "".join(chr(ord(c) + 0xFEE0) for c in "Wide"), "расе of trust", "ofﬁce", "β-carotene and CO₂ (κ = 1) – … “x”",
        "Раннее и позднее", f"می{zwnj}شود", "", None, "Ω-3 arm", f"a{zwnj}b", "оценka и тест",
    ]
    got = {r["row_id"] for r in visual.find_disguised(one_field(spark, texts), "row_id", ["title"]).collect()}
    assert got == {1, 2, 3, 4, 5, 6, 13, 14}
    forms = {r["row_id"]: r["form"] for r in visual.consistent_form(one_field(spark, texts), "row_id", ["title"]).collect()}
    assert forms[1] == unicodedata.normalize("NFC", texts[1]) and forms[2] == "word" and forms[3] == "a b" and forms[4] == "Wide" and forms[5] == "pace of trust" and forms[6] == "office"
    assert forms[10] == "" and forms[11] is None and forms[7] == texts[7] and forms[9] == texts[9]


# ---- survivorship ----


def test_best_values(spark):
    rows = [
        (1, "T", "An abstract that says a lot about the study.", "https://a.example/x.pdf", "2020", "10.1234/abc", "2024-01-01"),
        (2, "T", "An abstract that says a lot about the study. And more.", "https://a.example/", "2031", "10.1234/", "2024-02-01"),
        (3, "T", "No abstract available.", "n/a", "2021", "doi:10.1234/zzz", "2024-03-01"),
        (4, "T", None, None, None, None, None),
        (5, "A long title that is repeated as abstract", "A long title that is repeated as abstract", "", "1890", "unknown", "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "row_id long, title string, abstract string, oa_url string, year string, doi string, date string").withColumn("loaded_at", F.to_timestamp(F.lit("2024-05-01")))
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 1), (2, 5), (3, 99)], "group_id long, row_id long")
    got = {(r["group_id"], r["field_name"]): r["row_id"] for r in survivor.best_values(m, df).collect()}
    assert got == {(1, "abstract"): 2, (1, "oa_url"): 1, (1, "year"): 3, (1, "doi"): 3}
    assert survivor.surviving_records(m, df).first()["year"] == "2021"


def test_undated_rows_are_placed_by_learned_order(spark):
    rows = []
    for g in range(1, 6):
        rows += [(g * 10, "t", None, None, None, "10.1234/px.1", "2024-01-01"), (g * 10 + 1, "t", None, None, None, "10.1234/jhl.1", "2024-02-01")]
    rows += [(90, "t", None, None, None, "10.1234/px.9", "2024-06-01"), (91, "t", None, None, None, "10.1234/jhl.9", None)]
    df = spark.createDataFrame(rows, "row_id long, title string, abstract string, oa_url string, year string, doi string, date string").withColumn("loaded_at", F.to_timestamp(F.lit("2024-05-01")))
    m = spark.createDataFrame([(r[0] // 10, r[0]) for r in rows], "group_id long, row_id long")
    got = {r["group_id"]: r["row_id"] for r in survivor.best_values(m, df).collect()}
    assert got[9] == 91 and got[1] == 11


def test_removed_dates_are_made_up_for(spark):
    rnd = random.Random(11)
    rows, best = [], {}
    steps = [("10.1234/px.", "https://repo.example/"), ("10.1234/jhl.", "https://journal.example/"), ("10.5678/fin.", "https://final.example/")]
    for g in range(120):
        k = rnd.randrange(2, 4)
        for i in range(k):
            doi, url = steps[i]
            # Every third date is missing.
            day = None if rnd.random() < 0.33 else f"2024-0{i + 1}-{rnd.randrange(10, 28)}"
            rows.append((g * 10 + i, "t", None, f"{url}{g}.pdf", None, f"{doi}{g}", day))
        best[g] = g * 10 + k - 1
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id long, title string, abstract string, oa_url string, year string, doi string, date string").withColumn("loaded_at", F.to_timestamp(F.lit("2024-05-01")))
    m = spark.createDataFrame([(r[0] // 10, r[0]) for r in rows], "group_id long, row_id long")
    got = survivor.best_values(m, df).collect()
    assert len(got) == 240
    assert sum(r["row_id"] == best[r["group_id"]] for r in got) / len(got) >= 0.98


def test_circular_precedence_is_none(spark):
    rows = [(g, f, k, d) for g, (ks) in enumerate([("a", "b"), ("b", "c"), ("c", "a")] * 3) for f in ["doi"] for d, k in enumerate(ks)]
    nodes = spark.createDataFrame([(g, f, k, f"2024-01-0{d + 1}") for g, f, k, d in rows], "group_id long, field_name string, kind string, d string").withColumn("last_day", F.to_date("d"))
    assert survivor.learn_precedence(nodes, "group_id").count() == 0


# ---- chunks ----


@pytest.mark.parametrize("seed", range(6))
def test_pieces_give_the_text_back(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice(["word ", "Sentence ends. ", "\n\n", "\r\n", "# Head\n", "x" * 400, "e" + chr(0x301), "```\ncode\n```\n", "。日本"]) for _ in range(400))
    for limit, overlap in ((500, 60), (120, 0), (50, 49), (1, 0)):
        ps = chunks.split_text(text, limit, overlap)
        assert all(b - a <= limit for a, b, _ in ps) and ps[-1][1] == len(text)
        assert all(ps[k + 1][0] == ps[k][1] - min(overlap, limit - 1) for k in range(len(ps) - 1))


def test_pieces_prefer_sections_and_skip_abbreviations():
    text = "Intro text, e.g. this one. " * 12 + "\n\n## Next\n\n" + "More words here. " * 10
    ps = chunks.split_text(text, 400, 20)
    assert ps[0][2] == "section" and text[ps[0][1] :].startswith("## Next")
    assert chunks.split_text("", 5, 1) == [(0, 0, "end")]


# ---- copies ----


def test_copies(spark):
    rows = [("The role of A in B: a study", "2010"), ("A study (ROLE of A in  B, the", "(2010)"), ("The role of B in A: a study", "2010"), ("Other", None), ("Other!", None), ("Other", ""), ("  ", "1"), (None, "1"), ("...", "n.d."), ("-", "n.d.")]
    df = spark.createDataFrame([(i + 1, t, y, 0) for i, (t, y) in enumerate(rows)], "row_id long, title string, year string, first long").select("row_id", "title", "year", "first")
    got = {r["row_id"]: (r["first"], r["copies"]) for r in formatting.copy_sets(df, "row_id").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 1), 9: (9, 2), 10: (9, 2)}


def test_rotations_share_a_fingerprint_and_swaps_do_not():
    rnd = random.Random(2)
    for _ in range(50):
        w = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 9))) for _ in range(6)]
        a, b = formatting.fingerprint(" ".join(w), "1"), formatting.fingerprint(" ".join(w[3:] + w[:3]), "1")
        assert a == b
    s = "banana bandana"
    assert formatting.least_rotation(s) == min(s[i:] + s[:i] for i in range(len(s)))


# ---- tokens ----


def test_tokens_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rnd = random.Random(4)
    texts = ["", None, "<|endoftext|> x", "a" * 3000, "naïve café 日本語 🧪👩‍🔬 don't WE'LL\r\n\t  x", "".join(rnd.choice("abcdefgh") for _ in range(5000)), "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.encode_texts(df).collect():
        assert r["ids"] == public.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids


def test_rank_queue_against_sorting():
    rnd = random.Random(5)
    q, items = tokens.RankQueue(50_000), []
    for _ in range(500):
        x = (rnd.randrange(50_000), rnd.randrange(100))
        items.append(x)
        q.push(*x)
    assert [q.pop() for _ in items] == sorted(items) and q.pop() is None


# ---- packing ----


def test_packing_keeps_all_and_overfills_none(spark):
    rnd = random.Random(6)
    sizes = [rnd.choice([0, 1, 5, 30, 60, 100, 250, None]) for _ in range(600)]
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "doc_id long, tokens long, part int").select("doc_id", "tokens", "part")
    out = packing.pack(df, 100, "doc_id", "tokens").toPandas()
    back = out.groupby("doc_id")["size"].sum()
    assert all(back[i] == (s or 0) for i, s in enumerate(sizes))
    fill = out.groupby("container")["size"].sum()
    assert fill.max() <= 100 and set(out.groupby("doc_id").size()[lambda x: x > 1].index) == {i for i, s in enumerate(sizes) if s and s > 100}
    used = fill[fill > 0]
    assert len(used) <= -(-used.sum() // 100) * 1.03 + 1
    assert packing.pack(df.limit(0), 100, "doc_id", "tokens").count() == 0


def test_evolution_beats_best_fit_decreasing():
    rnd = random.Random(12)
    won = 0
    for seed in range(6):
        # Triplets that fill a bin exactly: hard for best fit.
        sizes = []
        for _ in range(40):
            a = rnd.randrange(380, 495)
            b = rnd.randrange(250, 1000 - a - 250 + 1)
            sizes += [a, b, 1000 - a - b]
        plain = packing.best_fit(packing.decreasing(list(range(120)), sizes), sizes, 1000)
        pop = packing.evolve(sizes, 1000, seed, generations=300)
        best = pop[0]
        assert sorted(i for b in best for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 1000 for b in best)
        assert packing.fitness(best, sizes, 1000) > packing.fitness(plain, sizes, 1000) and len(best) <= len(plain)
        won += len(best) < len(plain)
    assert won


# ---- linkage ----


def test_linkage(spark):
    words = ["adaptive", "mobile", "structured", "cognitive"], ["coaching", "feedback", "tutoring"], ["anxiety", "reading", "sleep"], ["nurses", "teachers", "carers"], ["Veldwick", "Hallowmoor", "Brackholm"]
    rnd = random.Random(8)
    works = [f"{rnd.choice(words[0])} {rnd.choice(words[1])} and long-term {rnd.choice(words[2])} in {rnd.choice(words[3])}: trial number {100 + i} in {rnd.choice(words[4])}" for i in range(60)]
    left = [(i + 1, w, f"Murq{'abcdefghij'[i % 10]}well, J.", "2020", f"PMID:{1000000 + i}", "pubmed") for i, w in enumerate(works)]
    right = [(1, works[3].replace("long-term", "lnog-term").upper(), "J. Murqdwell", "2020", None, None), (2, works[7] + ", part 2", "Murqhwell J", "2020", None, None), (3, None, None, None, None, None), (4, "A text on something else entirely", "X", "1999", None, None)]
    schema = "id long, title string, authors string, year string, tail string, source string"
    got = {(r["left_id"], r["right_id"]) for r in linkage.link(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert got == {(4, 1)}
    assert linkage.link(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).limit(0)).count() == 0


def met(left, right, counts, total=100_000):
    """Whether a candidate and an item, each (title, authors, year), share a blocking key."""
    spelling = linkage.Spelling(counts, total)
    wide, narrow = (linkage.keys_of(linkage.parse(*x, None, None, spelling), spelling, w) for x, w in ((left, True), (right, False)))
    return not set(wide).isdisjoint(narrow)


def test_titles_of_rare_words_meet():
    counts = {"reading": 900, "pupils": 800}
    assert met(("Kaingang phonotactics", None, None), ("Kaingang phonotactics.", None, None), counts)
    assert met(("Xylophagy", None, None), ("Xylophagy", None, None), counts)
    assert met(("Kaingang phonotactics revisited by Wiesemann", None, None), ("Kaingang phonotactics revis...", None, None), counts)
    assert met(("Kaingang reading", None, None), ("Kaingang reading in ...", None, None), counts)
    assert met(("Kaingang verbs", None, "1999"), ("Kaingang vrbs", None, "2000"), counts)
    assert met(("カインガング語の音韻", None, None), ("カインガング語の音韻", None, None), counts)
    assert not met(("Kaingang verbs", None, None), ("Guarani nouns", None, None), counts)


def test_short_titles_meet():
    counts = {"reading": 900, "fluency": 800, "pupils": 700, "coaching": 600, "anxiety": 500}
    assert met(("Reading fluency", "Murq, J.", "2020"), ("Reading fluency", "J. Murq", "2021"), counts)
    assert met(("Reading fluency of pupils", "Murq, J.", "2020"), ("Reading fl...", "J. Murq", "2020"), counts)
    assert met(("Reading", "Murq, J.", "2020"), ("Reading fluency of pupils", "J. Murq", "2020"), counts)
    assert met(("Reading fluency", None, None), ("Reading fluency", None, None), counts)
    # The common start of four words, with a year but without a name.
    assert met(("Coaching reading fluency pupils anxiety", None, "2020"), ("Coaching reading fluency pupils anx...", None, "2020"), counts)
    assert not met(("Reading fluency", "Murq, J.", "2020"), ("Coaching anxiety", "J. Murq", "2020"), counts)


# ---- abuse ----


def test_abuse_scores(spark):
    z = chr(0x200B)
    bad = ["You are a complete 1d10t and everyone here knows it.", f"K{z}ill yourself, c-l-o-w-n, and spare us.", "Migrants are v*rmin and should be thrown out of every school.", "Hot naaaked women on cam, click now for free XXX.", "S h u t your mouth and quit.", "Tu n'es qu'une ordure, personne ne veut de toi ici."]
    good = ["A forum member wrote “go to hell, moron”; the post was removed and coded as abuse.", "Nude mice were killed by cervical dislocation after 4 weeks.", "This is a weak paper and the conclusion is nonsense, frankly.", "Hit me with the remaining 12 abstracts, I will kill the backlog.", "Prejudice against migrants was measured with an 8-item scale.", "", " ", None, "The kill switch stopped the dumb terminal before the script could hit the master node."]
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(bad + good)], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in abuse.score_documents(df).filter("score >= 0.5").collect()}
    assert got == set(range(len(bad)))
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in abuse.rates_by_source(df).collect()}
    assert rates == {"s": (7, 3), None: (8, 3)}


def seeds_only():
    return abuse.Scorer(abuse.fit_scorer(abuse.seeds()))


def test_unseen_wording_scores():
    model, scorer = abuse.CharModel({}, set()), seeds_only()
    bad = ["Those people should all be gassed.", "I will hurt your family tonight.", "People from that country are scum by birth.", "Somebody ought to burn your house down with you in it.", "Refugees ought to be drowned, all of them."]
    good = ["The mice were gassed after four weeks.", "We will review your manuscript tonight.", "Refugees ought to be interviewed, all of them.", "People from that country are older on average.", "This paper is nonsense, frankly."]
    for t in bad:
        assert abuse.document_score(t, model, scorer)[0] >= 0.5, t
    for t in good:
        assert abuse.document_score(t, model, scorer)[0] < 0.5, t
    # A quotation is not the passage's own wording.
    assert abuse.document_score("“Those people should all be gassed.”", model, scorer)[0] == 0.0


def test_cached_scores_equal_the_plain_sum():
    import numpy as np

    scorer, rnd = seeds_only(), random.Random(5)
    words = sorted({w for x, _ in abuse.seed_sentences(400) for w in x.split()}) + ["死ね死ね", "“", "”", "тебя", "3d"]
    for _ in range(300):
        p = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9)))
        own, quoting = abuse.own_text(p)
        if not abuse.tokens_of(own):
            assert scorer.score(p) == (0.0, 0.0, 0.0)
            continue
        i, v = abuse.features(own, quoting)
        z = (scorer.weights[i] * np.asarray(v)[:, None]).sum(0)
        assert all(abs(a - 1 / (1 + abuse.math.exp(-b))) < 1e-4 for a, b in zip(scorer.score(p), z)), p


def test_decoding_is_exact():
    """The Viterbi passes against all readings of small lattices."""
    from itertools import product

    rnd = random.Random(9)
    model = abuse.CharModel({rnd.choice("^abdehiost") + rnd.choice("abdehiost") + rnd.choice("abdehiost$"): float(rnd.randrange(1, 50)) for _ in range(400)}, set())
    for _ in range(60):
        lattice = [[(x, rnd.random() * 3) for x in rnd.sample(["a", "b", "d", "i", "o", "s", "t", "", "h"], 3)] for _ in range(rnd.randrange(1, 6))]
        readings = {}
        for path in product(*lattice):
            t = "".join(x for x, _ in path)
            readings[t] = max(readings.get(t, -1e9), model._extended("", t + "$") - sum(c for _, c in path))
        best = max(readings.values())
        assert abs(readings[model.best_reading(lattice)] - best) < 1e-9
        hidden = {t for t in readings if t in abuse._HIDDEN}
        assert (model.hidden_reading(lattice, "") in hidden) if hidden else model.hidden_reading(lattice, "") is None


def test_long_disguised_words_are_restored():
    model = abuse.CharModel({}, set())
    assert abuse.restore("you m0therfu" + "c" * 20 + "ker", model) == ("you motherfucker", 1)
    assert abuse.restore("you " + "-".join("motherfucker"), model)[0] == "you motherfucker"


def test_runs_of_masks_and_long_stretches_are_restored():
    model = abuse.CharModel({}, set())
    for text, word in [("f*** you", "fuck"), ("f***ing hell", "fucking"), ("you wh**e", "whore"), ("you b****", "bitch"), ("f### you", "fuck"), ("a--hole", "asshole"), ("you n*****", "nigger"), ("you idi" + "o" * 30 + "t", "idiot"), ("b" + "i" * 15 + "t" * 15 + "ch", "bitch")]:
        assert word in abuse.restore(text, model)[0].split(), text
    assert abuse.restore("you s**t", model)[0] in ("you shit", "you slut") and abuse.restore("you s***", model)[0] in ("you shit", "you slut")
    assert abuse.document_score("f*** you", model, seeds_only())[0] >= 0.5
    for text in ["**i** think", "0.05***", "women--and others", "__x__", "***"]:
        assert abuse.restore(text, model) == (text, 0)


def test_frequent_stretched_spellings_are_restored(spark):
    texts = ["You are stuuupid."] * 40 + [f"You are an idiiot, number {'abcdefghij'[i]}." for i in range(9)] + ["The root of the matter."] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = abuse.learn_model(df)
    assert model.words.isdisjoint({"stuuupid", "idiiot"}) and "are" in model.words
    assert abuse.restore("stuuupid idiiot", model) == ("stupid idiot", 2)
    assert abuse.CharModel({}, {"root", "stuuupid", "hell"}).words == {"root", "hell"}
    # One text, however often it is copied, makes no word known.
    assert "matter" not in model.words
    assert {r["doc_id"] for r in abuse.score_documents(df).filter("score >= 0.5").collect()} >= set(range(40, 49))


def test_every_stand_in_of_the_table_is_examined(spark):
    # One word per character that stands in for another by itself, with an ordinary letter before it.
    chars = [r[0] for r in visual.code_point_rows() if r[4] and r[2] == "wide"][:: 7] + [chr(0x37E), chr(0x387), chr(0x675), chr(0x958), chr(0x13AA), chr(0xA4EE)]
    df = spark.createDataFrame([(i, f"ab {c} cd") for i, c in enumerate(chars)], "row_id long, title string")
    examined = {r["row_id"] for r in visual._examined(visual.long_fields(df, "row_id", ["title"]), "row_id").collect()}
    assert examined == set(range(len(chars)))
    found = {r["row_id"] for r in visual.find_disguised(spark.createDataFrame([(1, "R" + chr(0xA4EE) + "ting scale"), (2, "a" + chr(0x37E) + "b")], "row_id long, title string"), "row_id", ["title"]).collect()}
    assert found == {1, 2}


def test_spelling_is_mended_alike_whatever_the_size_of_the_list():
    small = {"anxiety": 9, "reading": 8, "adaptive": 7}
    rnd = random.Random(3)
    large = small | {"".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)): 5 for _ in range(12_000)}
    for counts in (small, large):
        s = linkage.Spelling(counts, 100_000)
        assert [s.mend(w) for w in ("anxeity", "raeding", "adpative", "adxptixe", "zzzzzz")] == ["anxiety", "reading", "adaptive", "adaptive", "?zzzzzz"]


def test_the_key_filter_loses_nothing(spark):
    import numpy as np

    keys = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(500)] + [0, -1, linkage.KEY_BITS - 1, 32767, 32768]
    bits = linkage.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"))
    held = linkage._held(np.asarray(keys, np.int64), bits)
    assert held.tolist() == keys
    others = np.arange(1, 10**6, 997, dtype=np.int64) * 4096 + 5
    assert len(linkage._held(others, bits)) < 20


def test_links_in_passes(spark, monkeypatch):
    # A filter of fixed size lets everything through when there are more keys than bits.
    assert linkage.filter_bits(1000) == linkage.KEY_BITS and linkage.filter_bits(20_000_000) >= 16 * 20_000_000 and linkage.filter_bits(10**12) == linkage.MOST_KEY_BITS
    rnd = random.Random(3)
    words = ["adaptive", "mobile", "structured"], ["coaching", "feedback", "tutoring"], ["anxiety", "reading", "sleep"], ["nurses", "teachers", "carers"], ["Veldwick", "Hallowmoor", "Brackholm"]
    works = [" ".join(rnd.choice(w) for w in words) + f" trial {i % 50}" for i in range(80)]
    schema = "id long, title string, authors string, year string, tail string, source string"
    left = spark.createDataFrame([(i, w, f"Murq{'abcdefghij'[i % 10]}well, J.", "2020", f"PMID:{1000000 + i}", "pubmed") for i, w in enumerate(works)], schema)
    right = spark.createDataFrame([(i, w.upper(), f"J. Murq{'abcdefghij'[i % 10]}well", "2020", None, None) for i, w in enumerate(works) if i % 3 == 0], schema)
    want = linkage.link(left, right).collect()
    monkeypatch.setattr(linkage, "PASS_KEYS", 700)
    monkeypatch.setattr(linkage, "PASS_PAIRS", 20)
    assert sorted(linkage.link(left, right).collect()) == sorted(want) and len(want) >= 27


def test_links_are_between_classes(spark):
    schema = "id long, title string, authors string, year string, tail string, source string"
    left = spark.createDataFrame([(i, "Adaptive coaching for reading in nurses at Veldwick", "Murqwell, J.", "2020", None, None) for i in range(1, 40)], schema)
    right = spark.createDataFrame([(i, "ADAPTIVE coaching for reading in nurses at Veldwick", "J. Murqwell", "2020", None, None) for i in (1, 2, 3)], schema)
    pairs, members, items = linkage.link_classes(left, right)
    (row,) = pairs.collect()
    assert (row["left_n"], row["right_n"]) == (39, 3) and members.select("cls").distinct().count() == 1 and items.count() == 3
    assert linkage.link(left, right).count() == 39 * 3
