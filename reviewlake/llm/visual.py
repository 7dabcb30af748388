"""Visually identical text with different characters: one consistent form.

Texts are cut into words; only words that may be out of form go on (a word of plain
letters, typographic marks or ideographs is in form already, and that test is one
regular expression in the JVM). Those words are exploded into positioned code points
and joined with a broadcast table of decompositions and look-alikes, whose size is
bounded by Unicode. The code points of a text come back together once; combining marks
are put in order of their class, sequences are recomposed, look-alike letters are
folded into the script of their word, and the words are rebuilt.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.lazy import arrow_udf
from reviewlake.session import parallel

# Letters of other scripts that look like a Latin letter, source then target.
CYRILLIC_LOOKALIKES = (
    "аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ѵv кk"
    " АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW Ӏl ѴV ҮY"
)
GREEK_LOOKALIKES = "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC"
# Greek letters in use as symbols, which count only inside an ordinary lower-case word.
GREEK_SYMBOL_LOOKALIKES = "αa γy ιi κk ρp υu χx ωw τt ηn"
OTHER_LOOKALIKES = "ɑa ɡg ɩi ʟL ʀR օo հh ոn սu ցg ℓl ꜱs ᴄc ᴏo ᴠv ᴡw ᴢz"
# Letters of further scripts that look like a Latin letter: Cherokee, Lisu, Coptic, and a dotless one.
CHEROKEE_LOOKALIKES = "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏒR ᏔW ᏚS ᏙV ᏞL ᏟC ᏢP ᏦK ᏴB"
LISU_LOOKALIKES = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
COPTIC_LOOKALIKES = "ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT ⲬX ȷj"
# Cyrillic letters with no Latin look-alike in the list above; text that has them is really Cyrillic.
TRUE_CYRILLIC = "бвгджзийлмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯёЁїЇєЄ"
# Invisible characters that are not of the format category.
OTHER_INVISIBLE = tuple(map(chr, (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x2800, 0x3164, 0xFFA0)))
ZWNJ, ZWJ = chr(0x200C), chr(0x200D)
NON_BREAKING_HYPHEN, IDEOGRAPHIC_SPACE, MICRO_SIGN = 0x2011, 0x3000, 0xB5
#: Tags of Unicode decompositions whose source stands in for its target.
STAND_IN_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Blocks whose letters need zero-width joiners of their own.
JOINING_SCRIPTS = ("ARABIC", "SYRIAC", "MONGOLIAN", "NKO", "MANDAIC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR", "TIBETAN")

def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


_CYR, _GRE, _SYM = map(_pairs, (CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, GREEK_SYMBOL_LOOKALIKES))
_OTH = {k: v for group in (OTHER_LOOKALIKES, CHEROKEE_LOOKALIKES, LISU_LOOKALIKES, COPTIC_LOOKALIKES) for k, v in _pairs(group).items()}


def _joins(ch: str) -> bool:
    name = unicodedata.name(ch, "")
    return name.startswith(JOINING_SCRIPTS)


def _cjk(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC"))


def code_point_rows() -> list[tuple[str, str, str, int, bool]]:
    """The table of code points that are not in form: character, what it becomes, kind, combining class, whether it is a stand-in."""
    rows = []
    look = {**_CYR, **_GRE, **_SYM, **_OTH}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        ccc = unicodedata.combining(ch)
        deco = unicodedata.decomposition(ch)
        tag = deco.split()[0] if deco.startswith("<") else ""
        to = unicodedata.normalize("NFKC", ch)
        if cat == "Cf" or ch in OTHER_INVISIBLE or 0xFE00 <= cp <= 0xFE0F:
            rows.append((ch, "", "invisible", ccc, True))
        elif cat == "Zs":
            rows.append((ch, " ", "space", ccc, True))
        elif cp == NON_BREAKING_HYPHEN:
            rows.append((ch, "-", "wide", ccc, True))
        elif tag in STAND_IN_TAGS and to != ch:
            rows.append((ch, to, "wide", ccc, True))
        elif tag == "<compat>" and to != ch and all(unicodedata.category(x)[0] in "LNM" for x in to):
            # The micro sign is a symbol: it folds, but nothing stands in for it.
            rows.append((ch, to, "wide", ccc, cp != MICRO_SIGN))
        elif deco and not tag and unicodedata.normalize("NFC", ch) != ch:
            rows.append((ch, unicodedata.normalize("NFC", ch), "wide", ccc, True))
        elif ccc or cat in ("Mn", "Mc", "Me"):
            rows.append((ch, ch, "mark", ccc, False))
        elif ch in look:
            rows.append((ch, look[ch], "lookalike", 0, True))
    return rows


@cache
def suspects() -> str:
    """Every character of the table for which a word must be examined by itself: all but Cyrillic and Greek letters, which count only among others."""
    return "".join(r[0] for r in code_point_rows() if r[2] != "lookalike" or r[0] in _OTH)


def code_point_table(spark: SparkSession) -> DataFrame:
    """The broadcast side of the code point join; bounded by the size of Unicode."""
    return spark.createDataFrame(code_point_rows(), "ch string, becomes string, kind string, ccc int, stand_in boolean")


@cache
def _latin(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith(("LATIN", "FULLWIDTH LATIN"))


@cache
def _script(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return "L" if name.startswith("LATIN") else "C" if name.startswith("CYRILLIC") else "G" if name.startswith("GREEK") else "O"


_BACK = {v: k for k, v in reversed(list(_CYR.items())) if v.isalpha()}


def _fold_run(run: str, truly_cyrillic: bool, mostly_latin: bool) -> str:
    """A run of letters with borrowed look-alikes put into one script; unchanged if none is borrowed."""
    base = [c for c in run if not unicodedata.combining(c)]
    kinds = [("X" if c in _OTH else _script(c)) for c in base]
    latin, cyr, greek, other = (sum(k == x for k in kinds) for x in "LCGX")
    if not (cyr or greek or other):
        return run
    if other and not latin and not cyr and not greek:
        return run
    if latin or other:
        lower = sum(c.islower() for c, k in zip(base, kinds) if k == "L")
        ordinary = len(base) >= 3 and lower * 2 >= latin and lower
        foreign = [c for c, k in zip(base, kinds) if k in "CGX"]
        # A Greek letter after or before capitals and digits is a symbol ("TNFα"), inside a word of small letters it is borrowed.
        table = {**_CYR, **_GRE, **_OTH, **(_SYM if ordinary else {})}
        if len(base) <= 2 and greek and not cyr and not other and any(c in _GRE and c.islower() for c in foreign) and not mostly_latin:
            return run
        if all(c in table for c in foreign):
            return "".join(table.get(c, c) if _script(c) != "L" or c in _OTH else c for c in run)
        if cyr and not greek and not other and all(c in _BACK for c, k in zip(base, kinds) if k == "L"):
            return "".join(_BACK.get(c, c) if _script(c) == "L" else c for c in run)
        return run
    if truly_cyrillic or not mostly_latin:
        return run
    if cyr and not greek and all(c in _CYR for c in base):
        return "".join(_CYR.get(c, c) for c in run)
    if greek and not cyr and len(base) >= 2 and all(c in _GRE or c in _SYM for c in base) and any(c in _GRE for c in base):
        return "".join(_GRE.get(c, _SYM.get(c, c)) for c in run)
    return run


def _rebuild(points: list[dict], truly_cyrillic: bool, mostly_latin: bool) -> tuple[str, bool]:
    """A word from its positioned code points: its consistent form, and whether a character was invisible or stood in for another."""
    case = False
    seen: list[str] = [p["ch"] for p in points]
    visible = [i for i, p in enumerate(points) if p["kind"] != "invisible"]
    chars: list[tuple[str, int]] = []
    for i, p in enumerate(points):
        ch, kind = p["ch"], p["kind"]
        if kind == "invisible":
            before = next((seen[j] for j in reversed(visible) if j < i), "")
            after = next((seen[j] for j in visible if j > i), "")
            if ch in (ZWNJ, ZWJ):
                doubled = i > 0 and seen[i - 1] == ch
                if before and after and not doubled and ((_joins(before) and _joins(after)) or (ch == ZWJ and unicodedata.category(before)[0] in "SM" and unicodedata.category(after)[0] == "S")):
                    chars.append((ch, 0))
                    continue
            if ch == ZWJ and before and after and unicodedata.category(after)[0] == "S":
                chars.append((ch, 0))
                continue
            if 0xFE00 <= ord(ch) <= 0xFE0F and before and unicodedata.category(before)[0] in "SN" or 0xE0020 <= ord(ch) <= 0xE007F:
                chars.append((ch, 0))
                continue
            case = True
            continue
        if kind == "space":
            near = seen[i - 1 : i] + seen[i + 1 : i + 2]
            case = case or not (ord(ch) == IDEOGRAPHIC_SPACE and (not near or any(_cjk(x) for x in near)))
            chars.append((" ", 0))
            continue
        if kind == "wide":
            near = [x for x in seen[max(0, i - 1) : i] + seen[i + 1 : i + 2]]
            own = unicodedata.category(ch)[0] in "PS" and unicodedata.name(ch, "").startswith(("FULLWIDTH", "HALFWIDTH")) and any(_cjk(x) for x in near)
            case = case or (p["stand_in"] and not own)
            chars.extend((x, unicodedata.combining(x)) for x in (ch if own else p["becomes"]))
            continue
        chars.append((ch, p["ccc"] or 0))
    # Combining marks in order of their class behind each starter, then recomposition.
    ordered, marks = [], []
    for ch, ccc in chars:
        if ccc:
            marks.append((ccc, len(marks), ch))
        else:
            ordered += [m[2] for m in sorted(marks)] + [ch]
            marks = []
    word = "".join(ordered + [m[2] for m in sorted(marks)])
    composed = unicodedata.normalize("NFC", word)
    case = case or composed != "".join(c for c, _ in chars)
    out, run = [], []
    for ch in composed + "\0":
        if ch.isalpha() or (run and unicodedata.combining(ch)):
            run.append(ch)
            continue
        if run:
            whole = "".join(run)
            folded = _fold_run(whole, truly_cyrillic, mostly_latin)
            case = case or folded != whole
            out.append(folded)
            run = []
        out.append(ch)
    return unicodedata.normalize("NFC", "".join(out)[:-1]), case


_POINT = "array<struct<w:int,c:int,ch:string,becomes:string,kind:string,ccc:int,stand_in:boolean>>"


@arrow_udf("struct<words:array<struct<w:int,form:string>>,disguised:boolean>")
def _rebuild_udf(points: pd.Series, truly_cyrillic: pd.Series, mostly_latin: pd.Series) -> pd.DataFrame:
    words_out, flags = [], []
    for pts, tc, ml in zip(points, truly_cyrillic, mostly_latin):
        by_word: dict[int, list[dict]] = {}
        for p in sorted(pts, key=lambda p: (p["w"], p["c"])):
            by_word.setdefault(p["w"], []).append(p)
        words, flag = [], False
        for w, own in by_word.items():
            form, case = _rebuild(own, bool(tc), bool(ml))
            words.append({"w": w, "form": form})
            flag = flag or case
        words_out.append(words)
        flags.append(flag)
    return pd.DataFrame({"words": words_out, "disguised": flags})


def _words(text: Column) -> Column:
    return F.split(text, r"(?<=[ \t\n\r])|(?=[ \t\n\r])")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def long_fields(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field_name, text`` of the named fields; other columns are left out."""
    return table.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")).select(key, "x.field_name", "x.text")


def _examined(long: DataFrame, key: str) -> DataFrame:
    """``key, field_name, words, disguised`` of the texts in which some word may be out of form."""
    spark = long.sparkSession
    latin = F.length(F.regexp_replace("text", r"[^\p{IsLatin}\x{ff21}-\x{ff5a}]", ""))
    cyrillic = F.length(F.regexp_replace("text", r"[^\p{IsCyrillic}]", ""))
    greek = F.length(F.regexp_replace("text", r"[^\p{IsGreek}]", ""))
    arabic = F.length(F.regexp_replace("text", r"[^\p{IsArabic}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    texts = long.filter(F.col("text").rlike(r"[^\x00-\x7f]")).select(
        key,
        "field_name",
        "text",
        _has(F.col("text"), f"[{TRUE_CYRILLIC}]{{1}}").alias("tc"),
        ((latin >= cyrillic) & (latin >= greek) & (latin >= arabic)).alias("ml"),
    )
    word = F.col("word")
    mixed = _has(word, r"[\p{IsCyrillic}\p{IsGreek}]") & (_has(word, r"\p{IsLatin}") | (F.col("ml") & (~F.col("tc") | _has(word, r"[\p{IsGreek}]{2}"))))
    words = texts.select(key, "field_name", "tc", "ml", F.posexplode(_words(F.col("text"))).alias("w", "word"))
    # Taking out the characters of the table is a look-up per character; a word that becomes shorter holds one.
    words = words.filter(_has(word, r"[^\x00-\x7f]") & ((F.translate(word, suspects(), "") != word) | mixed))
    points = words.select(key, "field_name", "tc", "ml", "w", F.posexplode(F.split("word", "")).alias("c", "ch"))
    known = points.join(F.broadcast(code_point_table(spark)), "ch", "left")
    whole = known.groupBy(key, "field_name").agg(
        F.first("tc").alias("tc"), F.first("ml").alias("ml"), F.collect_list(F.struct("w", "c", "ch", "becomes", F.coalesce("kind", F.lit("plain")).alias("kind"), "ccc", "stand_in")).alias("points")
    )
    return whole.select(key, "field_name", _rebuild_udf("points", "tc", "ml").alias("r")).select(key, "field_name", "r.words", "r.disguised")


def find_disguised(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field_name`` of the fields in which a character is invisible or stands in for the ordinary one.

    Null and empty fields are none; typographic quotes, dashes and ellipses, raised and lowered
    digits, symbols, text in another script and joiners that a script needs are none either.
    ``key`` must be unique in ``table``.
    """
    return _examined(long_fields(parallel(table.select(key, *fields), key), key, fields), key).filter("disguised").select(key, "field_name")


def consistent_form(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field_name, form, disguised``: every field in one form in which equal-looking texts are equal.

    A null field stays null and an empty one empty, neither is disguised. White space keeps its
    place; only characters that look like an ordinary space become one.
    """
    long = long_fields(parallel(table.select(key, *fields), key), key, fields)
    done = _examined(long, key).withColumn("fixed", F.map_from_entries("words"))
    both = long.join(done, [key, "field_name"], "left")
    rebuilt = F.array_join(F.transform(_words(F.col("text")), lambda w, i: F.coalesce(F.element_at("fixed", i), w)), "")
    return both.select(key, "field_name", F.when(F.col("fixed").isNull(), F.col("text")).otherwise(rebuilt).alias("form"), F.coalesce("disguised", F.lit(False)).alias("disguised"))
