"""Queries over recorded assessments, and their SQL.

The test tables hold no assessments, so every candidate gets two, of kinds that follow from its number; every fault that a served text can
have occurs. What must come out of each kind is stated here, not computed by the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import assessment as A
from reviewlake.operators import criteria as cr
from reviewlake.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KINDS = 25
I1, I2, E1 = A.CRITERIA[0], A.CRITERIA[1], A.CRITERIA[6]


def query(name: str, sql: str | None = None):
    """Register a query with its SQL."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def _item(ident: str, status: str = "not_reported", evidence: str = "[]", reason: str = "none", more: str = "") -> str:
    return f'{{"id":"{ident}","status":"{status}","evidence":{evidence},"reason":"{reason}"{more}}}'


def _content(first: str | None = None, others: dict[str, str] | None = None, order: tuple[str, ...] = A.MODEL_CRITERIA, schema: str = A.SCHEMA, more: str = "") -> str:
    items = [first if c == I1 and first is not None else (others or {}).get(c) or _item(c) for c in order]
    return f'{{"schema":"{schema}","criteria":[{",".join(items)}]{more}}}'


_Q = '[{"source":"T","quote":"Case @"}]'
#: The served text of each kind; @ stands for the number of the case.
CONTENTS = (
    _content(),
    _content(_item(I1, "not_met", _Q), {E1: _item(E1, "met", _Q)}),
    _content(_item(I1, "maybe")),
    _content(_item(I1, "met")),
    _content(_item(I1, "not_reported", _Q)),
    _content(_item(I1, "met", '[{"source":"S1","quote":"absent words"}]')),
    _content(_item(I1, "met", '[{"source":"S1","quote":"First ... of"}]')),
    _content(_item(I1, "met", '[{"source":"S9","quote":"x"}]')),
    _content(_item(I1, "met", '[{"source":"T","quote":" "}]')),
    _content(_item(I1, more=',"note":1')),
    _content(more=',"x":1'),
    _content(schema="other"),
    _content(order=(I2, I1, *A.MODEL_CRITERIA[2:])),
    _content(_item(I1, reason=" ")),
    '{"schema": oops',
    _content(_item(I1, "met", _Q), {E1: _item(E1, "met", _Q)}),
    f'{{"schema":"{A.SCHEMA}","schema":"{A.SCHEMA}","criteria":[]}}',
    f'{{"schema":"{A.SCHEMA}","criteria":"none"}}',
    _content('"text"'),
    _content(_item(I1, "met", '[{"source":"S2","quote":"First sentence"}]')),
    _content(_item(I1, evidence='"no"')),
    _content(_item(I1, "met", '[{"source":"T"}]')),
    "[1]",
    "",
    _content(_item(I1, "met", _Q), {c: _item(c, "met" if c[0] == "I" else "not_met", _Q) for c in A.MODEL_CRITERIA[1:]}),
)
_REST = ", ".join(f"''{c}''" for c in A.MODEL_CRITERIA[2:])
#: The errors of each kind.
ERRORS = {
    2: ["criteria[0].status is invalid: ''maybe''"], 3: ["criteria[0]: met requires evidence"], 4: ["criteria[0]: not_reported forbids evidence"], 5: ["criteria[0].evidence[0].quote not found in S1"], 6: ["criteria[0].evidence[0]: quote contains ellipsis"],
    7: ["criteria[0].evidence[0].source is invalid: ''S9''"], 8: ["criteria[0].evidence[0].quote is empty"], 9: ["criteria[0] fields are invalid"], 10: ["top-level fields must be exactly schema and criteria"], 11: [f"schema must be {A.SCHEMA}"],
    12: [f"criterion order/coverage mismatch: [''{I2}'', ''{I1}'', {_REST}]"], 13: ["criteria[0].reason is empty"], 14: ["invalid JSON: Expecting value"], 16: ["duplicate JSON key: schema"], 17: ["criteria must be an array"],
    18: [f"criterion order/coverage mismatch: [None, ''{I2}'', {_REST}]", "criteria[0] must be an object"], 19: ["criteria[0].evidence[0].quote found in S1, declared S2"], 20: ["criteria[0].evidence must be an array"],
    21: ["criteria[0].evidence[0] fields are invalid"], 22: ["assessment JSON must be an object"], 23: ["response content is empty"],
}
INCOHERENT, FAULTLESS, INCOMPLETE = 15, (0, 1, 24), (14, 16, 17, 18, 22, 23)
CATEGORIES = ("known_reasoner_false_positive", "holdout_exclude", "state_coverage_boundary", "known_chat_low_score_true_positive", "holdout_include")
BLOCKS = ("A", "B", "C", "D", "B")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def cases(s: SparkSession, d: str) -> DataFrame:
    """A case per candidate."""
    n = F.col("row_id")
    return table(s, d, "candidates").select(
        n.cast("string").alias("case_id"), "row_id", F.concat(F.lit("Case "), n.cast("string")).alias("title"), F.concat(F.lit("First sentence of "), n.cast("string"), F.lit(". Second one here.")).alias("abstract"),
        _pick(("en", "fr", ""), n % 3).alias("language"), _pick(("2021", "2020", "20x", ""), n % 4).alias("publication_year"), _pick(CATEGORIES, n % 5).alias("category"), _pick(BLOCKS, n % 5).alias("bloc"),
        F.when(n % 2 == 0, "include").otherwise("exclude").alias("human_label"), F.array(F.lit(I1), F.lit(E1)).alias("expected"),
    )


def results(s: SparkSession, d: str) -> DataFrame:
    """The result rows of two replicates per case."""
    slots = A.call_slots(cases(s, d))
    # Half of the calls are without fault, and two of three cases get the same answer twice.
    x = (F.col("row_id") + F.when(F.col("row_id") % 3 == 0, 7 * F.col("replicate")).otherwise(0)) % (2 * KINDS)
    kind = F.when(x < KINDS, x).otherwise(F.element_at(F.array(*[F.lit(k) for k in FAULTLESS]), (x % 3 + 1).cast("int")))
    return A.assessment_results(slots.withColumn("content", F.replace(_pick(CONTENTS, kind), F.lit("@"), F.col("case_id"))), mislabels=True)


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_CASES = ", ".join(f"({k}, {_texts(ERRORS.get(k, []))})" for k in range(KINDS))
EXPECTED = f"""WITH cs AS (SELECT row_id, CAST(row_id AS VARCHAR) AS case_id, ['en', 'fr', ''][row_id % 3 + 1] AS lang, ['2021', '2020', '20x', ''][row_id % 4 + 1] AS yr, {list(CATEGORIES)}[row_id % 5 + 1] AS category, {list(BLOCKS)}[row_id % 5 + 1] AS bloc,
  CASE WHEN row_id % 2 = 0 THEN 'include' ELSE 'exclude' END AS human_label FROM candidates),
kx AS (SELECT cs.*, CAST(r AS INTEGER) AS replicate, (row_id + CASE WHEN row_id % 3 = 0 THEN 7 * r ELSE 0 END) % {2 * KINDS} AS x FROM cs, (VALUES (1), (2)) t(r)),
k AS (SELECT *, CASE WHEN x < {KINDS} THEN x ELSE {list(FAULTLESS)}[x % 3 + 1] END AS m FROM kx),
e AS (SELECT k.*, v.errs AS validation_errors, m NOT IN {INCOMPLETE} AS complete, CASE WHEN m = {INCOHERENT} THEN ['E1 requires {I1} to be not_met or not_reported'] ELSE []::VARCHAR[] END AS coherence_errors,
  CASE WHEN m IN {INCOMPLETE} THEN []::VARCHAR[] ELSE list_filter([CASE WHEN m = 1 THEN '{I1}' END, CASE WHEN lang = 'fr' THEN 'I5_ENGLISH' END, CASE WHEN yr = '2020' THEN 'I6_AFTER_2020' END, CASE WHEN m IN (1, {INCOHERENT}) THEN '{E1}' END], lambda x: x IS NOT NULL) END AS hard_fails
  FROM k JOIN (VALUES {_CASES}) v(kind, errs) ON v.kind = k.m),
f AS (SELECT *, len(validation_errors) = 0 AND len(coherence_errors) = 0 AS valid FROM e),
res AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_assessment' WHEN m = 24 AND lang = 'en' AND yr = '2021' THEN 'include' ELSE 'needs_manual' END AS route FROM f),
pr AS (SELECT case_id, bloc, human_label, count(*) = 2 AS complete, count(*) = 2 AND bool_and(valid) AS valid, list_sort(list_distinct(flatten(list(hard_fails)))) AS observed, list(list_sort(hard_fails)) AS sets FROM res GROUP BY 1, 2, 3),
pairs AS (SELECT *, CASE WHEN valid THEN list_sort(list_intersect(sets[1], sets[2])) ELSE []::VARCHAR[] END AS reproduced, complete AND sets[1] = sets[2] AS identical FROM pr)
"""


@query(
    "crm_results",
    EXPECTED
    + """SELECT case_id, replicate, validation_errors, coherence_errors, hard_fails, complete, valid, route, CASE category WHEN 'state_coverage_boundary' THEN NULL WHEN 'holdout_exclude' THEN len(coherence_errors) = 0 AND route <> 'include'
  ELSE CASE WHEN NOT complete OR NOT valid THEN FALSE WHEN category = 'known_reasoner_false_positive' THEN list_has_any(hard_fails, ['"""
    + f"{I1}', '{E1}"
    + """']) WHEN category = 'known_chat_low_score_true_positive' THEN len(hard_fails) = 0 AND route IN ('include', 'needs_manual') ELSE len(hard_fails) = 0 END END AS accepted FROM res""",
)
def _results(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).select("case_id", "replicate", "validation_errors", "coherence_errors", "hard_fails", "complete", "valid", "route", "accepted")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return cr.pair_summaries(results(s, d).withColumn("identity_type", F.lit("case")).withColumn("replicate", _pick(("a", "b"), F.col("replicate") - 1)))


query("crm_pairs", EXPECTED + "SELECT case_id, bloc, human_label, complete, valid, observed, reproduced, identical FROM pairs")(lambda s, d: _pairs(s, d).select("case_id", "bloc", "human_label", "complete", "valid", "observed", "reproduced", "identical"))
query(
    "crm_block_a",
    EXPECTED
    + f"""SELECT replicate, count(*) FILTER (WHERE valid AND list_has_any(hard_fails, ['{I1}', '{E1}'])) AS oracle_hits, (SELECT count(*) FROM cs WHERE bloc = 'A') AS oracle_total,
  count(*) FILTER (WHERE valid AND list_has_any(hard_fails, ['{I1}', '{E1}'])) >= 2 AS oracle_pass, count(*) FILTER (WHERE valid AND human_label = 'include' AND len(hard_fails) > 0) AS include_false,
  count(*) FILTER (WHERE valid AND human_label = 'exclude' AND route = 'include') AS exclude_routed_include FROM res WHERE bloc = 'A' GROUP BY 1""",
)(lambda s, d: A.block_a(results(s, d), cases(s, d).filter("bloc = 'A'")))


def _targets(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).filter("bloc = 'C'").select("case_id", F.when(F.col("row_id") % 2 == 0, E1).otherwise("I5_ENGLISH").alias("criterion"))


_TARGETS = f"targets AS (SELECT case_id, CASE WHEN row_id % 2 = 0 THEN '{E1}' ELSE 'I5_ENGLISH' END AS criterion FROM cs WHERE bloc = 'C')"
query(
    "crm_block_c",
    EXPECTED + f", {_TARGETS} SELECT criterion, count(DISTINCT t.case_id) AS cases, count(*) AS records, count(*) FILTER (WHERE NOT valid OR list_contains(hard_fails, criterion)) AS violations FROM targets t JOIN res USING (case_id) GROUP BY 1",
)(lambda s, d: A.block_c(results(s, d), _targets(s, d)))
query("crm_target_violations", EXPECTED + f", {_TARGETS} SELECT case_id, criterion, 'reproduced' AS violation FROM targets JOIN pairs USING (case_id) WHERE list_contains(reproduced, criterion)")(lambda s, d: A.target_violations(_pairs(s, d), _targets(s, d)))
query(
    "crm_criterion_stability",
    EXPECTED + f"SELECT criterion, count(*) AS pairs_n, count(*) FILTER (WHERE list_contains(sets[1], criterion) = list_contains(sets[2], criterion)) AS identical_n FROM pairs, (SELECT unnest({list(A.CRITERIA)}) AS criterion) WHERE valid GROUP BY 1",
)(lambda s, d: A.criterion_stability(_pairs(s, d)))
query(
    "crm_verdict",
    EXPECTED
    + f""", {_TARGETS}, a AS (SELECT replicate, count(*) FILTER (WHERE valid AND list_has_any(hard_fails, ['{I1}', '{E1}'])) >= 2 AND count(*) FILTER (WHERE valid AND human_label = 'include' AND len(hard_fails) > 0) = 0 AND count(*) FILTER (WHERE valid AND human_label = 'exclude' AND route = 'include') = 0 AS ok FROM res WHERE bloc = 'A' GROUP BY 1),
v AS (SELECT 'a' AS criterion, count(*) FILTER (WHERE m = 3) = 0 AS ok FROM res UNION ALL SELECT 'b', count(*) FILTER (WHERE NOT valid) / count(*) <= 0.1 FROM res UNION ALL SELECT 'c', bool_and(ok) FROM a
UNION ALL SELECT 'd', count(*) FILTER (WHERE NOT valid OR list_contains(hard_fails, criterion)) = 0 FROM targets JOIN res USING (case_id) UNION ALL SELECT 'e', count(*) FILTER (WHERE valid AND human_label = 'include' AND len(hard_fails) > 0) = 0 FROM res
UNION ALL SELECT 'f', count(*) FILTER (WHERE identical) / count(*) >= 0.9 FROM pairs)
SELECT criterion, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM v UNION ALL SELECT 'overall', CASE WHEN bool_and(ok OR criterion = 'f') THEN 'not falsified' ELSE 'falsified' END FROM v""",
)(lambda s, d: A.verdict(results(s, d), cases(s, d).filter("bloc = 'A'"), _targets(s, d)))


@query(
    "crm_coverage_errors",
    """SELECT CAST(row_id AS VARCHAR) AS case_id, 2 AS replicate, 'missing' AS error FROM candidates WHERE row_id % 50 = 0 UNION ALL SELECT CAST(row_id AS VARCHAR), 1, 'duplicate' FROM candidates WHERE row_id % 60 = 1
UNION ALL SELECT 'x' || row_id, 1, 'foreign' FROM candidates WHERE row_id % 70 = 2 UNION ALL SELECT CAST(row_id AS VARCHAR), 3, 'invalid_replicate' FROM candidates WHERE row_id % 80 = 3""",
)
def _coverage(s: SparkSession, d: str) -> DataFrame:
    """Results with every kind of gap."""
    n, known = F.col("row_id"), cases(s, d)
    slots = A.call_slots(known).select("row_id", "case_id", "replicate").filter(~((n % 50 == 0) & (F.col("replicate") == 2)))
    more = [known.filter(n % 60 == 1).select("case_id", F.lit(1).alias("replicate")), known.filter(n % 70 == 2).select(F.concat(F.lit("x"), "case_id").alias("case_id"), F.lit(1).alias("replicate")), known.filter(n % 80 == 3).select("case_id", F.lit(3).alias("replicate"))]
    rows = slots.select("case_id", "replicate")
    for x in more:
        rows = rows.unionByName(x)
    return A.coverage_errors(rows, known)


#: The class of the error of each kind under the last rules but one.
_CLASSES = {2: "status", 3: "requires evidence", 4: "quote/evidence grounding", 5: "quote/evidence grounding", 6: "quote/evidence grounding", 7: "quote/evidence grounding", 8: "quote/evidence grounding", 9: "field shape", 10: "schema", 11: "schema", 12: "criterion order/coverage", 13: "reason", 14: "other validation", 15: "coherence", 16: "other validation", 17: "other validation", 19: "source-label mismatch", 20: "quote/evidence grounding", 21: "quote/evidence grounding", 22: "other validation", 23: "other validation"}
_CLASS_SQL = ", ".join(f"({k}, '{c}')" for k, c in [*_CLASSES.items(), (18, "criterion order/coverage"), (18, "other validation")])
# Two kinds hold the name of a field that a rule looks for: the schema of the repeated key, the schema of an unreadable text is not in its error.
_CLASS_SQL = _CLASS_SQL.replace("(16, 'other validation')", "(16, 'schema')")
query("crm_taxonomy", EXPECTED + f"SELECT c.name AS error_class, count(*) AS n FROM res JOIN (VALUES {_CLASS_SQL}) c(kind, name) ON c.kind = res.m GROUP BY 1")(
    lambda s, d: cr.error_taxonomy(results(s, d).withColumn("errors", F.concat("validation_errors", "coherence_errors")), "v3")
)
_REASONS = f"""CASE WHEN NOT complete THEN 'incomplete_pair' WHEN NOT valid THEN 'invalid_pair' WHEN human_label = 'include' AND list_contains(reproduced, 'I5_ENGLISH') THEN 'include_violation' WHEN human_label <> 'exclude' THEN 'label_not_exclude'
  WHEN bloc = 'D' THEN 'title_only' WHEN NOT list_contains(reproduced, 'I5_ENGLISH') THEN 'not_reproduced' WHEN len(list_filter(observed, lambda x: x <> 'I5_ENGLISH')) > 0 THEN 'other_hard_fail' ELSE 'proposal' END"""
query("crm_assisted", EXPECTED + f"SELECT case_id, {_REASONS} AS reason FROM pairs")(lambda s, d: A.assisted_routes(_pairs(s, d).withColumn("title_only", A.is_title_only(F.lit(None).cast("string"), F.col("bloc") == "D")), "I5_ENGLISH"))


@query(
    "crm_replay",
    """SELECT run, count(*) AS total, count(*) FILTER (WHERE k IN (0, 1)) AS before, count(*) FILTER (WHERE k IN (0, 1, 2)) AS after FROM (SELECT CASE WHEN row_id % 2 = 0 THEN 'x' ELSE 'y' END AS run, row_id % 5 AS k FROM candidates) GROUP BY 1""",
)
def _replay(s: SparkSession, d: str) -> DataFrame:
    """Old assessments: without evidence, with an exact quote, with one in other letters, with one that is nowhere, and unreadable ones."""
    served = [_content(schema=A.SCHEMA_V0)] + [_content(_item(I1, "met", f'[{{"source":"title","quote":"{q}"}}]'), schema=A.SCHEMA_V0) for q in ("Case @", "CASE @", "nowhere")] + ["{"]
    n = F.col("row_id")
    rows = cases(s, d).select(F.when(n % 2 == 0, "x").otherwise("y").alias("run"), "title", "abstract", F.replace(_pick(tuple(served), n % 5), F.lit("@"), F.col("case_id")).alias("content"))
    return A.replay_counts(rows)
