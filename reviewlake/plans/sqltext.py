"""Fragments of the SQL that queries are checked against."""

from __future__ import annotations

import unicodedata
from functools import cache


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def _values(kind: str) -> str:
    """A list of characters and what they become: in NFKD where that is no canonical decomposition, or by case folding where that is no lower case."""
    pairs = []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        if kind == "compat":
            to = unicodedata.normalize("NFKD", ch)
            keep = to != unicodedata.normalize("NFD", ch)
        else:
            to = ch.casefold()
            keep = to != ch.lower() and to == to.lower()
        if keep:
            pairs.append(f"({_quoted(ch)}, {_quoted(to)})")
    return "VALUES " + ", ".join(pairs)


def normal_form(table: str, key: str, column: str, name: str, fold: bool = False) -> str:
    """A common table ``name(key, t)``: the column in NFKC, case-folded if asked. Characters are replaced one by one and composed again."""

    def step(source: str, kind: str, suffix: str, after: str) -> str:
        return f"""{name}_{suffix} AS (SELECT {key}, {after.format("coalesce(string_agg(coalesce(m.t, x.c), '' ORDER BY x.i), '')")} AS t FROM (SELECT {key}, unnest(CASE WHEN t = '' THEN [''] ELSE string_split(t, '') END) AS c, unnest(range(1, greatest(2, length(t) + 1))) AS i FROM {source}) x
  LEFT JOIN ({_values(kind)}) m(c, t) ON m.c = x.c GROUP BY {key})"""

    out = f"{name}_0 AS (SELECT {key}, coalesce({column}, '') AS t FROM {table}), " + step(f"{name}_0", "compat", "1", "nfc_normalize({})")
    last = f"{name}_1"
    if fold:
        out += ", " + step(f"{name}_1", "fold", "2", "lower({})")
        last = f"{name}_2"
    return out + f", {name} AS (SELECT * FROM {last})"



def strip(x: str) -> str:
    """Stripped of outer white space."""
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def nb(x: str) -> str:
    """Stripped, null if nothing is left."""
    return f"nullif({strip(x)}, '')"


def title(x: str) -> str:
    """The normalised title of text that is in normal form and folded."""
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def year(x: str) -> str:
    """A usable year."""
    return rf"CASE WHEN regexp_full_match({strip(x)}, '(19|20)\d{{2}}') THEN CAST({strip(x)} AS INTEGER) END"


def score(x: str) -> str:
    """A clamped score."""
    return rf"CASE WHEN regexp_full_match({strip(x)}, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, CAST({strip(x)} AS DOUBLE))) END"


#: White space as the normalisers know it.
SPACES = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def evidence(x: str) -> str:
    """Text in normal form, normalised for evidence. A letter between two line ends is shared by two matches, so there are two passes."""
    join = rf"regexp_replace({{}}, '([\p{{{{L}}}}\p{{{{N}}}}_])-[ \t]*\r?\n[ \t]*([\p{{{{L}}}}\p{{{{N}}}}_])', '\1\2', 'g')"
    bare = f"replace({x}, chr(173), '')"
    return rf"trim(regexp_replace({join.format(join.format(bare))}, '{SPACES}', ' ', 'g'))"


KIND = f"coalesce({nb('identity_type')}, 'doi')"
KNOWN = (
    "((stage = 'dedup' AND decision = 'merge') OR (stage IN ('screen_title_abstract', 'screen_fulltext') AND decision IN ('include', 'exclude', 'needs_manual'))"
    " OR (stage IN ('human_review', 'screen_manual', 'human_review_fulltext') AND decision IN ('include', 'exclude'))"
    " OR (stage = 'fulltext' AND decision IN ('retrieved', 'retrieval_failed', 'include', 'needs_manual'))"
    " OR (stage = 'extract' AND decision IN ('extracted', 'not_found', 'api_error', 'rejected_citation', 'citation_retry', 'include', 'needs_manual')))"
)
#: Journal lines with a document, ``k`` and ``d`` its identity.
LINES = f"lines AS (SELECT *, {KIND} AS k, {nb('doc')} AS d FROM decisions WHERE {nb('doc')} IS NOT NULL)"
KNOWN_LINES = f"known AS (SELECT * FROM lines WHERE coalesce({KNOWN}, FALSE))"


def resolved(machine: str, human: str, machine_decisions: str, name: str) -> str:
    """A common table of resolved documents."""
    h = f"stage IN ({human}) AND decision IN ('include', 'exclude')"
    m = f"stage IN ({machine}) AND decision IN ({machine_decisions})"
    return f"""{name} AS (
  SELECT k AS identity_type, d AS doc, coalesce(max_by(decision, seq) FILTER (WHERE {h}), max_by(decision, seq) FILTER (WHERE {m})) AS decision,
    CASE WHEN count(*) FILTER (WHERE {h}) > 0 THEN 'human' ELSE 'machine' END AS resolved_by,
    coalesce(max(seq) FILTER (WHERE {h}), max(seq) FILTER (WHERE {m})) AS decided_seq, min(seq) FILTER (WHERE ({h}) OR ({m})) AS first_seq
  FROM known WHERE ({h}) OR ({m}) GROUP BY k, d)"""


SCREEN = resolved("'screen_title_abstract'", "'human_review', 'screen_manual'", "'include', 'exclude'", "screen")
ELIGIBLE = resolved("'screen_fulltext'", "'human_review_fulltext'", "'include', 'exclude', 'needs_manual'", "eligible")
FULLTEXT = """got AS (SELECT k AS identity_type, d AS doc, max_by(decision, seq) AS decision, max(seq) AS seq FROM known WHERE stage = 'fulltext' GROUP BY k, d
  HAVING max_by(decision, seq) IN ('retrieved', 'include'))"""
QUEUE = """queue AS (SELECT k AS identity_type, d AS doc, max_by(score, seq) AS score, max(seq) AS seq FROM known WHERE stage = 'screen_title_abstract' GROUP BY k, d
  HAVING max_by(decision, seq) = 'needs_manual' AND (k, d) NOT IN (SELECT k, d FROM known WHERE stage IN ('human_review', 'screen_manual')))"""
JOURNAL = f"WITH {LINES}, {KNOWN_LINES}"

#: Gold rows: label of the last human decision, score and model of the last machine screening line.
GOLD = f"""{JOURNAL}, human AS (SELECT k, d, max_by(decision, seq) AS label FROM lines WHERE stage IN ('human_review', 'screen_manual') AND decision IN ('include', 'exclude') GROUP BY k, d),
machine AS (SELECT k, d, max_by(struct_pack(s := score, m := model), seq) AS x FROM known WHERE stage = 'screen_title_abstract' GROUP BY k, d),
gold AS (SELECT k AS identity_type, d AS doc, label, {score('x.s')} AS score, coalesce({nb('x.m')}, '(none)') AS stratum FROM human JOIN machine USING (k, d)),
routed AS (SELECT *, label = 'include' AS y, score >= 0.75 AS p, CASE WHEN score >= 0.75 THEN 'include' WHEN score <= 0.25 THEN 'exclude' ELSE 'needs_manual' END AS route
  FROM gold WHERE label IN ('include', 'exclude') AND score IS NOT NULL)"""


def matrix(pred: str = "p", w: str = "1.0::DOUBLE") -> str:
    """The four cells of a confusion matrix."""
    return ", ".join(f"sum(CASE WHEN {a} THEN {w} ELSE 0.0::DOUBLE END) AS {n}" for a, n in ((f"y AND {pred}", "tp"), (f"NOT y AND {pred}", "fp"), (f"y AND NOT {pred}", "fn"), (f"NOT y AND NOT {pred}", "tn")))


def ratios(src: str, keep: str = "*") -> str:
    """Metrics over a table of matrices."""
    return f"""SELECT {keep}, round(rc, 4) AS recall, round(pr, 4) AS precision, round(CASE WHEN rc + pr = 0 THEN 0 ELSE 2 * rc * pr / (rc + pr) END, 4) AS f1,
  round(CASE WHEN 1 - pe = 0 THEN 0 ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM (
  SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rc, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS pr,
    CASE WHEN n_all = 0 THEN 0.0 ELSE (tp + tn) / n_all END AS po,
    CASE WHEN n_all = 0 THEN 0.0 ELSE ((tp + fp) / n_all) * ((tp + fn) / n_all) + ((fn + tn) / n_all) * ((fp + tn) / n_all) END AS pe
  FROM (SELECT *, tp + fp + fn + tn AS n_all FROM ({src})))"""


def _rounds(n: int) -> str:
    """So many rounds of label propagation, each over the identifiers that rows share."""
    out = "l0 AS MATERIALIZED (SELECT row_id, row_id AS label FROM candidates)"
    for k in range(n):
        out += f""",
v{k} AS MATERIALIZED (SELECT kind, value, min(label) AS m FROM ids JOIN l{k} USING (row_id) GROUP BY kind, value),
l{k + 1} AS MATERIALIZED (SELECT row_id, least(l{k}.label, coalesce(min(m), l{k}.label)) AS label FROM l{k} LEFT JOIN ids USING (row_id) LEFT JOIN v{k} USING (kind, value) GROUP BY row_id, l{k}.label)"""
    return out


#: Components of candidates that share an identifier; the test tables need fewer rounds than these.
COMPONENTS = f"""WITH ids AS MATERIALIZED (SELECT DISTINCT row_id, kind, value FROM (
  SELECT row_id, 'doi' AS kind, {nb('doi')} AS value FROM candidates UNION ALL SELECT row_id, 'source_id', {nb('source_id')} FROM candidates UNION ALL SELECT row_id, 'oa_url', {nb('oa_url')} FROM candidates) WHERE value IS NOT NULL),
{_rounds(14)},
components AS (SELECT row_id, label AS component FROM l14)"""
QUALITY = f"({nb('abstract')} IS NOT NULL, {nb('oa_url')} IS NOT NULL, coalesce({year('year')}, 0), -row_id)"
