"""Several values packed in one field: expectation-maximisation segmentation.

A field is read as a chain of atoms with separators between them. Quoted spans
and the strings of a JSON list are closed atoms. Strong separators (semicolon,
bar, line break, tab, bullet) always divide values; weak ones (comma, spaced
slash, ampersand, a word for "and") may be part of a value. The ambiguity is a
lattice over the atoms; its arcs are the possible values.

The model of a value is a mixture of how often that very value occurs in the
column and how often values of its shape occur ("Surname, I." is a shape). Both
are learned from the whole column by expectation-maximisation: the first counts
come from places without ambiguity, then forward-backward sums over each lattice
give expected counts. A Viterbi pass over the lattice takes the likeliest split.

Distribution: every distinct text is worked on once. Value frequencies may be as
many as there are values, so they are never collected: arcs meet them in a join by
value hash that spreads hot values over slices. Only values counted more than ``DISCOUNT`` times are evidence, so only
those go into that join, and of an arc only its number and value travel. Shapes
are hashed to ``SHAPE_BUCKETS`` slots, so that table is bounded as well.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.lazy import arrow_udf
from reviewlake.operators.skew import join_hot
from reviewlake.session import cut, spread

SHAPE_BUCKETS = 1 << 16
#: Spans of up to so many atoms are possible values everywhere; longer ones where a value of that length is attested.
SHORT_SPAN = 8
#: Expected counts below this are rounding errors of the sums they go into.
PRECISION = 1e-6
#: What each weak separator inside a value costs, as a factor.
JOIN_PRIOR = {",": 0.05, "and": 0.05, "/": 0.02}
#: How much of the probability of a value is due to its own frequency rather than its shape.
LEXICAL_SHARE = 0.5
#: What a count must exceed to be evidence: a value seen once proves nothing about where it ends.
DISCOUNT = 1.5
#: The probability of one word, and of one initial, given the shape of a value.
WORD_P, INITIAL_P = 1 / 2000, 1 / 30

# Words for "and" between values.
AND_WORDS = ("and", "und", "et", "y", "e", "og", "och", "en", "и", "&")
# Name suffixes.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")

_STRONG = re.compile(r"[;；|\n\r\t•·‖]|(?<=\s)//(?=\s)")
_WEAK = re.compile(r"\s*[,，]\s*(?:(?:and|und|et|&)(?=\s)\s*)?|\s+/\s+|\s+(?:" + "|".join(re.escape(w) for w in AND_WORDS) + r")\s+")
_LEAD = re.compile(r"^(?:(?:and|und|et)\s+|&\s*)(?=\S)")
_TOKEN = re.compile(r"[^\s,]+|,")


def _pieces(text: str) -> list[tuple[str, bool]]:
    """The parts of ``text`` between strong separators, each with whether it is a closed (quoted) atom."""
    body = text.strip()
    if body[:1] == "[" and body[-1:] == "]":
        try:
            items = json.loads(body)
        except ValueError:
            items = None
        if isinstance(items, list) and all(isinstance(x, (str, int, float)) or x is None for x in items):
            return [(str(x).strip(), True) for x in items if x is not None and str(x).strip()]
    out: list[tuple[str, bool]] = []
    at, start, n = 0, 0, len(body)

    def plain(lo: int, hi: int) -> None:
        piece = body[lo:hi].strip().strip(",，").strip()
        if piece:
            out.append((piece, False))

    while at < n:
        if body[at] == '"' and (not body[start:at].strip() or body[start:at].rstrip()[-1] in ",，"):
            # An opening quote stands at the start of a piece, after white space or a comma.
            end = at + 1
            while end < n:
                if body[end] == "\\" and end + 1 < n and body[end + 1] in '"\\':
                    end += 2
                    continue
                if body[end] == '"':
                    if end + 1 < n and body[end + 1] == '"':
                        end += 2
                        continue
                    break
                end += 1
            after = body[end + 1 :].lstrip("  ")
            if end < n and (not after or after[0] in ",，;；|\n\r\t•·/&" or re.match(r"(?:and|und|et)\b", after)):
                plain(start, at)
                inner = re.sub(r'""|\\(["\\])', lambda m: m[1] or '"', body[at + 1 : end]).strip()
                if inner:
                    out.append((inner, True))
                at = start = end + 1
                # The separator after a quoted span is used up with it.
                m = re.compile(r"\s*(?:[,，]\s*(?:(?:and|und|et|&)\s+)?|/|(?:and|und|et|&)\s+)").match(body, at)
                if m:
                    at = start = m.end()
                continue
        m = _STRONG.match(body, at)
        if m:
            plain(start, at)
            at = start = m.end()
            continue
        at += 1
    plain(start, n)
    return out


def _lattice(text: str) -> list[tuple[list[str], list[str], bool]]:
    """For each piece: its atoms, the weak separators between them as written, and whether it is closed."""
    found = []
    for piece, closed in _pieces(text):
        if closed:
            found.append(([piece], [], True))
            continue
        piece = _LEAD.sub("", piece).strip(" ,， ")
        if not piece:
            continue
        atoms, seps, at = [], [], 0
        for m in _WEAK.finditer(piece):
            if m.start() <= at and not atoms:
                continue
            atoms.append(piece[at : m.start()])
            seps.append(m[0])
            at = m.end()
        atoms.append(piece[at:])
        # An empty atom is not a value: its two separators count as one.
        keep_atoms, keep_seps = [atoms[0]], []
        for sep, atom in zip(seps, atoms[1:]):
            if not atom.strip():
                continue
            if not keep_atoms[-1].strip():
                keep_atoms[-1] = atom
                continue
            keep_seps.append(sep)
            keep_atoms.append(atom)
        found.append((keep_atoms, keep_seps, False))
    return found


def _sep_kind(sep: str) -> str:
    bare = sep.strip()
    if "/" in bare:
        return "/"
    if bare in (",", "，"):
        return ","
    return ",and" if bare[:1] in ",，" else "and"


def shape(value: str) -> tuple[str, float]:
    """The shape of a value, and the log-probability of its words given the shape."""
    out, logp = [], 0.0
    for tok in _TOKEN.findall(value):
        bare = tok.strip(".")
        if tok == ",":
            kind = ","
        elif bare.lower() in SUFFIXES and out:
            kind, logp = "J", logp + math.log(INITIAL_P)
        elif tok in AND_WORDS:
            kind = "&"
        elif re.fullmatch(r"(?:[^\W\d_]\.-?)+|[^\W\d_]|[A-ZÀ-Þ]{1,3}", tok) and tok[:1].upper() == tok[:1]:
            kind, logp = "I", logp + math.log(INITIAL_P)
        elif bare[:1].isdigit():
            kind, logp = "9", logp + math.log(WORD_P)
        elif bare[:1].islower():
            kind, logp = "w", logp + math.log(INITIAL_P)
        else:
            kind, logp = "W", logp + math.log(WORD_P)
        if kind in "Iw" and out and out[-1] == kind:
            continue
        out.append(kind)
    return re.sub("wW", "W", "".join(out)), logp


def _bucket(field: str, value: str) -> tuple[int, float]:
    s, logp = shape(value)
    return zlib.crc32(f"{field}\u0001{s}".encode()) % SHAPE_BUCKETS, logp


def _key(field: str, value: str) -> int:
    """A 63-bit hash of a value; letter case and inner white space do not matter."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{field}\u0001{' '.join(value.casefold().split())}") >> 1


def _joined(atoms: list[str], seps: list[str], i: int, j: int) -> str:
    text = atoms[i]
    for k in range(i, j):
        text += seps[k] + atoms[k + 1]
    return text.strip()


def _arcs(field: str, text: str, lengths: frozenset[int] = frozenset()) -> dict[str, list]:
    """The arcs of the lattices of ``text``, as parallel lists: piece, first and last atom, value hash, shape, log-probability of the words, prior, flags.

    An arc spans up to ``SHORT_SPAN`` atoms, a number of atoms in ``lengths`` (those of longer values that are attested
    somewhere), or its whole piece.
    """
    pieces = _lattice(text)
    strong = sum(not closed for _, _, closed in pieces) > 1 and bool(_STRONG.search(text.strip())) and '"' not in text
    out: dict[str, list] = {c: [] for c in ARC_COLUMNS}
    for p, (atoms, seps, closed) in enumerate(pieces):
        n = len(atoms)
        joins = [sum(math.log(JOIN_PRIOR[x]) for x in re.findall(",|and|/", _sep_kind(sep))) for sep in seps]
        for i in range(n):
            ends = [i + k - 1 for k in range(1, SHORT_SPAN + 1)] + [i + k - 1 for k in lengths if k > SHORT_SPAN]
            if i == 0 and n - 1 not in ends:
                ends.append(n - 1)
            for j in ends:
                if j >= n:
                    continue
                value = _joined(atoms, seps, i, j)
                if not value:
                    continue
                bucket, logp = _bucket(field, value)
                # Without ambiguity: closed atoms, single atoms, and whole pieces of a text that strong separators divide.
                sure = closed or n == 1 or (strong and i == 0 and j == n - 1 and not any("and" in _sep_kind(x) for x in seps))
                # The span of a whole undivided text would only learn itself by heart, and its copies would confirm it.
                whole = not strong and not closed and n > 1 and i == 0 and j == n - 1
                for c, v in zip(ARC_COLUMNS, (p, i, j, _key(field, value), bucket, logp, sum(joins[i:j]), SURE * sure + WHOLE * whole)):
                    out[c].append(v)
    return out


#: Columns of the arcs of a text; flags of an arc.
ARC_COLUMNS = ("p", "i", "j", "k", "b", "w", "a", "f")
SURE, WHOLE = 1, 2
_ARC = "struct<p:array<int>,i:array<int>,j:array<int>,k:array<bigint>,b:array<int>,w:array<float>,a:array<float>,f:array<tinyint>>"


def _make_arcs(lengths: frozenset[int]):
    @F.pandas_udf(_ARC)
    def run(field: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_arcs(f, t, lengths) for f, t in zip(field, text)], columns=list(ARC_COLUMNS))

    return run


@arrow_udf("array<int>")
def _long_values(field: pd.Series, text: pd.Series) -> pd.Series:
    """How many atoms the unambiguous values of a text have where those are more than ``SHORT_SPAN``."""
    out = []
    for t in text:
        pieces = _lattice(t)
        strong = len(pieces) > 1
        sizes = set()
        for atoms, seps, closed in pieces:
            if closed:
                sizes.add(len(_WEAK.findall(atoms[0])) + 1)
            elif strong and not any("and" in _sep_kind(x) for x in seps):
                sizes.add(len(atoms))
        out.append(sorted(x for x in sizes if x > SHORT_SPAN))
    return pd.Series(out, dtype=object)


class _Model:
    """What the arcs of a text are scored by: the total of counts and the probabilities of the shape slots."""

    def __init__(self, total: float, shapes: dict[int, float]) -> None:
        self.total = total
        # An array of fixed size, whatever the data.
        self.log_shape = np.full(SHAPE_BUCKETS, -np.inf, np.float32)
        for b, x in shapes.items():
            if x > 0:
                self.log_shape[b] = math.log(x)

    def log_p(self, arcs: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
        """The log-probabilities of arcs whose values have the given counts."""
        a = np.asarray(arcs["a"], float)
        shape_p = self.log_shape[np.asarray(arcs["b"], int)].astype(float)
        # A shape never seen gets less the more separators it would swallow.
        shape_p = np.where(np.isfinite(shape_p), shape_p, math.log(0.1 / self.total) + a)
        by_shape = math.log(1 - LEXICAL_SHARE) + shape_p + np.asarray(arcs["w"], float)
        with np.errstate(divide="ignore"):
            lexical = np.log(LEXICAL_SHARE * np.maximum(0.0, counts - DISCOUNT) / self.total)
        return np.logaddexp(lexical, by_shape) + a


def _counts(n: int, met: list | None) -> np.ndarray:
    out = np.zeros(n)
    for m in met if met is not None else ():
        out[m["at"]] = m["c"]
    return out


def _by_piece(p: np.ndarray) -> list[tuple[int, np.ndarray]]:
    pieces, starts = np.unique(p, return_index=True)
    return [(int(x), np.arange(s, e)) for x, s, e in zip(pieces, starts, [*starts[1:], len(p)])]


def _expect(arcs: dict[str, np.ndarray], met: list | None, weight: float, model: _Model) -> tuple[list[int], list[int], list[float]]:
    """Forward-backward over the lattices of a text: value hashes, shapes and expected counts of its arcs."""
    k, b, f = arcs["k"], arcs["b"], arcs["f"]
    logs = model.log_p(arcs, _counts(len(k), met))
    ks, bs, xs = [], [], []
    for _, at in _by_piece(np.asarray(arcs["p"])):
        first, last = arcs["i"][at].tolist(), arcs["j"][at].tolist()
        n = max(last) + 1
        if n == 1:
            ks.append(int(k[at[0]])), bs.append(int(b[at[0]])), xs.append(weight)
            continue
        lp = logs[at].tolist()
        fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        fwd[0] = bwd[n] = 0.0
        order = sorted(range(len(at)), key=lambda x: last[x])
        for x in order:
            fwd[last[x] + 1] = _log_add(fwd[last[x] + 1], fwd[first[x]] + lp[x])
        for x in sorted(order, key=lambda x: -first[x]):
            bwd[first[x]] = _log_add(bwd[first[x]], bwd[last[x] + 1] + lp[x])
        z = fwd[n]
        if z == -math.inf:
            continue
        for x, g in enumerate(at):
            p = math.exp(min(0.0, fwd[first[x]] + lp[x] + bwd[last[x] + 1] - z)) * weight
            # Below the precision of the counts that they are added to.
            if p > PRECISION and not f[g] & WHOLE:
                ks.append(int(k[g])), bs.append(int(b[g])), xs.append(p)
    return ks, bs, xs


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _viterbi(arcs: dict[str, np.ndarray], met: list | None, model: _Model) -> list[tuple[int, int, int]]:
    """The likeliest path through each lattice, as (piece, first atom, last atom); of equally likely ones that with fewer values."""
    logs = model.log_p(arcs, _counts(len(arcs["k"]), met))
    path = []
    for p, at in _by_piece(np.asarray(arcs["p"])):
        first, last, lp = np.asarray(arcs["i"])[at].tolist(), np.asarray(arcs["j"])[at].tolist(), logs[at].tolist()
        n = max(last) + 1
        best = [(-math.inf, 0, 0)] * (n + 1)
        best[0] = (0.0, 0, 0)
        for x in sorted(range(len(lp)), key=lambda x: (last[x], first[x])):
            score = best[first[x]][0] + lp[x]
            cand = (score, best[first[x]][1] - 1, first[x])
            if cand > best[last[x] + 1]:
                best[last[x] + 1] = cand
        e, steps = n, []
        while e > 0:
            s = best[e][2]
            steps.append((p, s, e - 1))
            e = s
        path.extend(reversed(steps))
    return path


def segment_values(table: DataFrame, key: str, fields: list[str], rounds: int = 2) -> DataFrame:
    """One row per row of ``table``, field and value: ``key, field_name, pos, item, n_items``.

    ``pos`` counts the values of a field from 1. Items are trimmed and come without
    separators, enclosing quotes and escapes. Defined cases: null, empty and blank
    fields, and fields of separators only, give no rows; an unclosed quote is an
    ordinary character; a single value gives one row with ``n_items`` 1; repeated
    values and rows are kept; other columns of ``table`` are ignored. A value that weak separators
    divide into more than ``SHORT_SPAN`` atoms comes out whole inside a longer field if a value of so many atoms is attested somewhere
    (quoted, or between strong separators), and always if it fills its piece.
    """
    long = table.select(F.col(key).alias("rk"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x"))
    long = long.select("rk", "x.field_name", "x.text").filter(F.col("text").rlike(r"[^\s\p{Z}]"))
    h1, h2 = F.xxhash64("field_name", "text"), F.xxhash64("text", F.lit("second"), "field_name")
    distinct = cut(long.groupBy("field_name", "text").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("tid", F.monotonically_increasing_id()))
    # Numbers of atoms: the list is as long as the longest value at most.
    many = distinct.filter(F.regexp_count("text", F.lit(r"[,，&/]|\s(?:" + "|".join(w for w in AND_WORDS if w != "&") + r")\s")) >= SHORT_SPAN)
    lengths = frozenset(r[0] for r in many.select(F.explode(_long_values("field_name", "text")).alias("x")).distinct().collect())
    # The arcs of each distinct text are worked out once.
    arcs = cut(spread(distinct, "tid").select("tid", "n", _make_arcs(lengths)("field_name", "text").alias("arcs")))
    ambiguous = arcs.filter(F.exists("arcs.j", lambda j: j > 0))

    # First counts, from what is not ambiguous.
    flat = arcs.select("n", F.explode(F.arrays_zip("arcs.k", "arcs.b", "arcs.f")).alias("a"))
    sure = flat.filter(F.col("a.f").bitwiseAND(SURE) > 0).select("a.k", "a.b", F.col("n").alias("x"))
    plain = cut(arcs.filter(~F.exists("arcs.j", lambda j: j > 0)).select("n", F.explode(F.arrays_zip("arcs.k", "arcs.b")).alias("a")).groupBy("a.k", "a.b").agg(F.sum("n").alias("x")))
    # Which arc of which text has which value, and how many arcs have it.
    keys = ambiguous.select("tid", F.posexplode("arcs.k").alias("at", "k"))
    held = cut(keys.groupBy("k").agg(F.count(F.lit(1)).alias("m")))
    arcs_total = float(held.agg(F.sum("m")).first()[0] or 0)

    def model(counts: DataFrame) -> tuple[DataFrame, _Model]:
        summed = cut(counts.groupBy("k", "b").agg(F.sum("x").alias("x")))
        lexicon = summed.groupBy("k").agg(F.sum("x").alias("c"))
        # At most SHAPE_BUCKETS rows come back.
        slots = {r["b"]: r["x"] for r in summed.groupBy("b").agg(F.sum("x").alias("x")).collect()}
        total = max(math.fsum(slots.values()), 1.0)
        return lexicon.filter(F.col("c") > DISCOUNT), _Model(total, {b: x / total for b, x in slots.items()})

    def with_counts(lexicon: DataFrame) -> DataFrame:
        """The ambiguous texts with the counts of those of their arcs that have more than the discount; the others are no evidence."""
        once = lexicon.join(held, "k")
        met = join_hot(keys, once, ["k"], "m", "tid", arcs_total).groupBy("tid").agg(F.collect_list(F.struct("at", "c")).alias("met"))
        return ambiguous.join(met, "tid", "left")

    lexicon, scorer = model(sure)
    for _ in range(rounds):
        expected = with_counts(lexicon).select(F.explode(_make_expect(scorer)("arcs", "met", "n")).alias("e")).select("e.k", "e.b", "e.x")
        lexicon, scorer = model(expected.unionByName(plain.select("k", "b", "x")))

    paths = with_counts(lexicon).select("tid", _make_viterbi(scorer)("arcs", "met").alias("path"))
    decoded = distinct.join(paths, "tid", "left").select("field_name", "text", "n", _items_udf("field_name", "text", "path").alias("items"))

    # Back to the rows by a hash of 128 bits; a text that many rows repeat is spread over slices.
    rows_total = distinct.agg(F.sum("n")).first()[0] or 0.0
    decoded = decoded.select(h1.alias("h1"), h2.alias("h2"), "n", "items")
    rows = long.select("rk", "field_name", h1.alias("h1"), h2.alias("h2"))
    met = join_hot(rows, decoded, ["h1", "h2"], "n", "rk", rows_total, per_slice=20_000)
    out = met.select("rk", "field_name", F.size("items").alias("n_items"), F.posexplode("items").alias("at", "item"))
    return out.select(F.col("rk").alias(key), "field_name", (F.col("at") + 1).cast("long").alias("pos"), "item", "n_items")


def _arc_rows(arcs: pd.DataFrame):
    return ({c: np.asarray(v) for c, v in zip(ARC_COLUMNS, row)} for row in zip(*(arcs[c] for c in ARC_COLUMNS)))


def _make_expect(model: _Model):
    @F.pandas_udf("array<struct<k:bigint,b:int,x:double>>")
    def run(arcs: pd.DataFrame, met: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[{"k": k, "b": b, "x": x} for k, b, x in zip(*_expect(a, m, w, model))] for a, m, w in zip(_arc_rows(arcs), met, n)], dtype=object)

    return run


def _make_viterbi(model: _Model):
    @F.pandas_udf("array<struct<p:int,i:int,j:int>>")
    def run(arcs: pd.DataFrame, met: pd.Series) -> pd.Series:
        return pd.Series([[{"p": p, "i": i, "j": j} for p, i, j in _viterbi(a, m, model)] for a, m in zip(_arc_rows(arcs), met)], dtype=object)

    return run


@arrow_udf("array<string>")
def _items_udf(field: pd.Series, text: pd.Series, path: pd.Series) -> pd.Series:
    out = []
    for f, t, steps in zip(field, text, path):
        pieces = _lattice(t)
        if steps is None:
            items = [_joined(a, s, 0, len(a) - 1) for a, s, _ in pieces]
        else:
            items = [_joined(pieces[x["p"]][0], pieces[x["p"]][1], x["i"], x["j"]) for x in steps]
        out.append([x for x in items if x.strip()])
    return pd.Series(out)

