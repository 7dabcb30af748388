"""Duplicates hidden by formatting differences, by commutative multiset hashing.

A title is reduced to its letters and digits in NFKC case-folded form. Where its parts
stand must not matter (a subtitle put in front, an article put behind), but stray
separators make it impossible to say for sure where parts begin. Moving a part is a
rotation of the letters, so the title is hashed as the multiset of the overlapping
letter runs of its cyclic form: that multiset is the same for every rotation, and words
that change places inside a part change it. Articles are values of their own. Every
(field name, value) pair is hashed and the hashes are added up, which needs no sorting;
the two 64-bit sums are the fingerprint. Every row of a group is then compared with the canonical
rotation of the first row of the group, and rows that differ are grouped again by it.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.lazy import arrow_udf
from reviewlake.operators.skew import join_hot
from reviewlake.session import cut, parallel

# Articles that a catalogue puts behind a title.
ARTICLES = frozenset("the a an le la les el los las der die das un une ein eine".split())
RUN = 8
_WORD = re.compile(r"[^\W_]+")
_MIX = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB))]


def letters_of(title: str) -> tuple[str, list[str]]:
    """The letters and digits of a title without its articles, and the articles."""
    text = unicodedata.normalize("NFKC", title).casefold()
    # Case folding may leave marks apart from their letters.
    text = unicodedata.normalize("NFC", text)
    # A mark that belongs to a letter is part of it; other marks and invisible characters are formatting.
    words = _WORD.findall("".join(c for c in text if unicodedata.category(c) != "Cf"))
    return "".join(w for w in words if w not in ARTICLES), sorted(w for w in words if w in ARTICLES)


def least_rotation(s: str) -> str:
    """The rotation of ``s`` that sorts first, in linear time."""
    n = len(s)
    i, j, k = 0, 1, 0
    while i < n and j < n and k < n:
        a, b = s[(i + k) % n], s[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        if i == j:
            j += 1
        k = 0
    at = min(i, j) if n else 0
    return s[at:] + s[:at]


def _hash_pair(name: str, value: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{name}\u0001{value}", seed=seed)


def _mixed_runs(s: str, odd: np.uint64, mul: np.uint64) -> int:
    """The sum of the mixed hashes of the letter runs of the cyclic form of ``s``."""
    n = len(s)
    if not n:
        return 0
    codes = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
    wrapped = np.concatenate([codes] * (1 + (RUN - 1) // n) + [codes[: (RUN - 1) % n]]) if n < RUN else np.concatenate([codes, codes[: RUN - 1]])
    x = np.zeros(n, np.uint64)
    for k in range(RUN):
        x = x * odd + wrapped[k : k + n] + np.uint64(1)
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * mul
    x ^= x >> np.uint64(31)
    return int(x.sum(dtype=np.uint64))


def year_value(year: str | None) -> str:
    """A year without spacing and punctuation; a placeholder of punctuation only keeps its signs, a null is a value of its own."""
    if year is None:
        return "\u0000"
    text = unicodedata.normalize("NFKC", year).casefold()
    bare = "".join(c for c in text if c.isalnum())
    return bare or "".join(text.split())


def fingerprint(title: str, year: str | None) -> tuple[int, int, str]:
    """The two sums over all (field name, value) pairs, and the canonical value they stand for."""
    s, articles = letters_of(title)
    y = year_value(year)
    sums = []
    with np.errstate(over="ignore"):
        for seed, (odd, mul) in enumerate(_MIX):
            total = _mixed_runs(s, odd, mul) + sum(_hash_pair("title.article", a, seed) for a in articles) + _hash_pair("year", y, seed)
            total += _hash_pair("title.length", str(len(s)), seed)
            total &= (1 << 64) - 1
            sums.append(total - (1 << 64) if total >> 63 else total)
    return sums[0], sums[1], "\u0001".join([least_rotation(s), " ".join(articles), y])


@arrow_udf("struct<h1:bigint,h2:bigint,canon:string>")
def _fingerprint_udf(title: pd.Series, year: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fingerprint(t, y) for t, y in zip(title, year)], columns=["h1", "h2", "canon"])


def _titled(table: DataFrame, key: str, title: str, year: str) -> DataFrame:
    """``key, t, y`` of the rows with a non-blank title."""
    return table.select(F.col(key), F.col(title).alias("t"), F.col(year).alias("y")).filter(F.col("t").rlike(r"[^\s\p{Z}]"))


def fingerprinted(rows: DataFrame, key: str) -> DataFrame:
    """``key, h1, h2, canon`` of rows ``key, t, y``."""
    return rows.select(key, _fingerprint_udf("t", "y").alias("f")).select(key, "f.h1", "f.h2", "f.canon")


def copy_sets(table: DataFrame, key: str, title: str = "title", year: str = "year") -> DataFrame:
    """``key, first, copies`` for every row with a non-blank title: the smallest key of its set and the size of the set.

    Rows are in one set if their titles have the same letters and digits but for where
    the parts stand, and their years are equal but for spacing and punctuation. A null year
    equals only a null year. Null and blank titles are in no set; a title without letters
    and digits equals every such title of the same year. Ties do not arise: keys are unique.

    Fingerprints are worked out once, and grouped by sums of 64 bits in a hash aggregate. Then every row of a set is
    compared with the canonical value of the first row of its set, by a hash join; sets of a third of all rows are spread over slices.
    Rows that differ in spite of an equal fingerprint are grouped again by their value.
    """
    marked = cut(fingerprinted(parallel(_titled(table, key, title, year), key), key))
    groups = marked.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    total = float(marked.count())
    firsts = marked.select(F.col(key).alias("first"), F.col("canon").alias("canon0")).join(groups.filter("n > 1").hint("shuffle_hash"), "first")
    same = F.col("canon") == F.col("canon0")
    met = cut(join_hot(marked, firsts, ["h1", "h2"], "n", key, total, hint="shuffle_hash").select(key, "first", "n", F.when(~same, F.col("canon")).alias("canon")))
    single = groups.filter("n = 1").select(F.col("first").alias(key), "first", F.lit(1).cast("long").alias("copies"))
    # Equal sums of different values: the sets lose those rows, which form their own by the value itself.
    wrong = met.filter("canon is not null")
    lost = wrong.groupBy("first").agg(F.count(F.lit(1)).alias("lost"))
    same = met.filter("canon is null").join(lost, "first", "left").select(key, "first", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("copies"))
    again = wrong.groupBy("canon").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    apart = wrong.select(key, "canon").join(again, "canon").select(key, "first", "copies")
    return same.unionByName(single).unionByName(apart)


def one_record_each(table: DataFrame, key: str, title: str = "title", year: str = "year") -> DataFrame:
    """One row per set: the row of the smallest key as ``key, title, year``, with ``copies``."""
    firsts = copy_sets(table, key, title, year).filter(F.col("first") == F.col(key)).select(key, "copies")
    return firsts.join(table.select(F.col(key), F.col(title).alias("title"), F.col(year).alias("year")), key).select(key, "title", "year", "copies")
