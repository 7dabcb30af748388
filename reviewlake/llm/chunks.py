"""Splitting oversized items at natural boundaries, with overlap.

The boundaries of a text form a hierarchy: section, paragraph, sentence, word,
character. A text is split at its sections, a section that is too long at its paragraphs, and so on down.
The parts are packed greedily: a piece takes whole parts as long as they fit. The next piece starts exactly the
overlap before its end, so consecutive pieces share that many characters.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.lazy import arrow_udf
from reviewlake.session import parallel

LEVELS = ("section", "paragraph", "sentence", "word", "character")
# Abbreviations after which a full stop does not end a sentence.
ABBREVIATIONS = "e.g i.e etc al fig figs eq no vol pp p cf vs approx dr prof mr mrs ms st ca resp z.b bzw u.a d.h usw nr abb tab art p.ej ej núm т.е т.д т.п рис"

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)", re.M)
_HEADING = re.compile(r"(?:^|(?<=\n)|(?<=\r))(?=#{1,6}[ \t])|(?<=\n)(?=[^\n\r]+\r?\n(?:={3,}|-{3,})[ \t]*(?:\r?\n|$))")
_BLANK_LINE = re.compile(r"(?:\r\n|\r(?!\n)|\n)[ \t]*(?:\r\n|\r|\n)+[ \t]*(?=\S)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(\[]?[^\W_])|(?<=[。！？])[」』”）]*")
_LINE = re.compile(r"(?:\r\n|\r|\n)(?=\S)")
_WORD = re.compile(r"\s+(?=\S)|(?<=[、，；：])|(?<=[぀-ヿ㐀-鿿])(?=[぀-ヿ㐀-鿿])")
_ABBREVIATED = re.compile(r"(?:^|[\s(\[])(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS.split()) + r")\.$", re.I)
_INITIAL = re.compile(r"(?:^|[\s.(])[^\W\d_]\.$")


def boundaries(text: str) -> dict[str, list[int]]:
    """The offsets at which a text may be cut, by level, in order."""
    fences = [m.start() for m in _FENCE.finditer(text)]

    def in_code(at: int) -> bool:
        return bisect.bisect_left(fences, at) % 2 == 1

    sections = [m.start() for m in _HEADING.finditer(text) if m.start() and not in_code(m.start())]
    paragraphs = [m.end() for m in _BLANK_LINE.finditer(text) if not in_code(m.end())]
    sentences = [m.end() for m in _SENTENCE.finditer(text) if not _ABBREVIATED.search(text[max(0, m.start() - 12) : m.start()]) and not _INITIAL.search(text[max(0, m.start() - 3) : m.start()])]
    sentences += [m.end() for m in _LINE.finditer(text)]
    words = [m.end() for m in _WORD.finditer(text)]
    return {"section": sections, "paragraph": paragraphs, "sentence": sorted(set(sentences)), "word": words}


def _whole_character(text: str, at: int, low: int) -> int:
    """The last offset up to ``at`` that parts neither a line end, a mark from its letter nor a joined sequence."""
    to = at
    while to > low and (unicodedata.combining(text[to]) or unicodedata.category(text[to]) in ("Mn", "Mc", "Me", "Cf") or text[to - 1] == chr(0x200D) or (text[to - 1] == "\r" and text[to] == "\n")):
        to -= 1
    return to if to > low else at


def _atoms(text: str, room: int, found: dict[str, list[int]]) -> list[tuple[int, str]]:
    """The ends of parts of at most ``room`` characters, each with the level of the separator behind it.

    A part that is too long is split at all separators of the coarsest level that it has inside; what is still too long goes down a
    level, at last to characters.
    """
    out: list[tuple[int, str]] = []
    todo = [(0, len(text), 0, "end")]
    while todo:
        low, high, depth, behind = todo.pop()
        if high - low <= room:
            out.append((high, behind))
            continue
        name = LEVELS[depth]
        if name == "character":
            at = low
            while high - at > room:
                at = _whole_character(text, at + room, at)
                out.append((at, name))
            out.append((high, behind))
            continue
        marks = found[name]
        inside = marks[bisect.bisect_right(marks, low) : bisect.bisect_left(marks, high)]
        edges = [low, *inside, high]
        # Parts are worked on from the first to the last.
        todo += [(a, b, depth + 1, behind if b == high else name) for a, b in reversed(list(zip(edges, edges[1:])))]
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """The pieces of ``text`` as (start, end, level of the cut at the end); one piece with level ``end`` if it fits.

    Parts from the recursion over the separators are packed greedily: a piece takes parts up to the limit, and the next piece
    starts the overlap before its end.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    overlap = max(0, min(overlap, limit - 1))
    pieces, start, last = [], 0, (0, "end")
    for end, level in _atoms(text, limit - overlap, boundaries(text)):
        if end - start > limit:
            pieces.append((start, *last))
            start = last[0] - overlap
        last = (end, level)
    pieces.append((start, *last))
    return pieces


_PIECES = "array<struct<piece_no:int,start:bigint,end:bigint,cut_at:string,text:string>>"


@arrow_udf(_PIECES)
def _pieces_udf(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    out = []
    for t, m, o in zip(text, limit, overlap):
        out.append([{"piece_no": k + 1, "start": a, "end": b, "cut_at": level, "text": t[a:b]} for k, (a, b, level) in enumerate(split_text(t, int(m), int(o)))])
    return pd.Series(out)


def pieces_of_oversized(items: DataFrame, limits: DataFrame, key: str = "text_id", text: str = "fulltext") -> DataFrame:
    """The pieces of every item longer than its limit: ``key, limit_name, piece_no, start, end, cut_at, text``.

    Lengths are code points. ``limits`` is the fixed table of a few rows and is broadcast;
    limits of another unit than characters, without a size or below 1 do not apply. Null and
    empty texts, texts within their limit, and texts whose limit is unknown give no piece. A null
    overlap is 0, an overlap of the limit or more is the limit less 1. Each piece is at most
    ``max_size`` long, and a piece starts exactly the overlap before its forerunner ends.
    """
    usable = limits.filter((F.col("unit") == "characters") & (F.col("max_size") >= 1)).groupBy("limit_name").agg(F.min("max_size").alias("max_size"), F.max(F.coalesce("overlap_size", F.lit(0))).alias("overlap_size"))
    long = parallel(items.select(key, "limit_name", F.col(text).alias("_text")), key).join(F.broadcast(usable), "limit_name").filter(F.length("_text") > F.col("max_size"))
    return long.select(key, "limit_name", F.explode(_pieces_udf("_text", "max_size", "overlap_size")).alias("p")).select(key, "limit_name", "p.*")
