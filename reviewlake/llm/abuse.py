"""Abusive, hateful or sexual content: noisy-channel deobfuscation, then a learned score.

Offensive words are written so that filters miss them: digits and signs for letters,
masks, stretched or spaced letters, letters of other scripts, invisible characters. Each
suspicious token becomes a lattice of characters: what was written may stand for several
letters, for none, or for part of a repetition. A character language model, learned from the
words of all documents, weighs the readings; a Viterbi pass over the lattice finds the likeliest reading, and one
over the lattice and the tree of often hidden words the likeliest of those. Both are exact.

The restored text is scored by passage with a linear model over words, pairs of words and letter runs. It is
fitted on a bounded sample of passages with weak labels (see :mod:`reviewlake.llm.weak_labels`) and on generated seed sentences.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.visual import _fold_run
from reviewlake.llm.weak_labels import GROUPS, INSULTS, STRONG, pattern_sentences, seed_label, seed_sentences
from reviewlake.session import cut, parallel

# What a written character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "ß": "b",
}
#: Signs that hide any letter, and signs that only part letters.
MASKS, SPACERS = "*_#%?-.", "-._*~ '"
ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"

#: Words whose hiding is likely: they raise the language model and are words for the decoder.
HIDDEN_WORDS = sorted(
    set(INSULTS)
    | set(
        "fuck fucking fucked fucker fucks shit shitty ass arse tits cock dick pussy cunt porn sex naked nude nudes hard horny naked die died dying kill killed killing rot yourself stupid dirty filthy vermin rats disease subhuman ugly fat idiot pathetic worthless braindead "
        "brainless spineless disgusting talentless hack liar pig cow ape goat rat shut hell mouth slap beat hate lick licking scream breasts bare hot wet live cam pills cage drown criminals lazy clown crybaby toad garbage human waste skin stain sack trash "
        "smelly wretched drooling hopeless break fingers regret mierda basura gilipollas imbécil gueule ordure vermine fresse dreck vollidiot verpiss ungeziefer plaga"
        .split()
    )
)


_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"|「[^」]*」|‘[^’\n]*’(?!\w)")
_PASSAGE = re.compile(r"(?<=[.!?…。！？])\s+|(?<=[。！？])|\n+")
_LEAD = re.compile(r"^\s*(?:>+|[-*•]|re:|@\w+|lol|haha)+\s*", re.I)


# Words whose double letter is no stretch of a hidden word.
DOUBLED = frozenset("root hoot looser".split())


def _stretched_form(word: str) -> bool:
    """Whether a word is a stretched spelling, however often it occurs."""
    short = _REPEATS.sub(r"\1", word)
    return bool(_STRETCH.search(word)) or (short != word and short in _HIDDEN and word not in _HIDDEN and word not in DOUBLED)


class CharModel:
    """A trigram model of the letters of words, and the words themselves."""

    def __init__(self, trigrams: dict[str, float], words: set[str]) -> None:
        total: dict[str, float] = {}
        for t, n in trigrams.items():
            total[t[:2]] = total.get(t[:2], 0.0) + n
        self.trigrams, self.total, self.words = trigrams, total, {w for w in words if not _stretched_form(w)}
        self.longest = max(map(len, self.words), default=0)
        self.restored: dict[str, tuple[str, int]] = {}

    def log_p(self, two: str, ch: str) -> float:
        """The log-probability of a letter after two others."""
        return math.log((self.trigrams.get(two + ch, 0.0) + 0.05) / (self.total.get(two, 0.0) + 0.05 * 50))

    def _extended(self, text: str, letters: str) -> float:
        out = 0.0
        for ch in letters:
            out += self.log_p(("^^" + text)[-2:], ch)
            text += ch
        return out

    def best_reading(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading of a lattice of (letters, cost) choices: a Viterbi pass whose states are the last two letters."""
        states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for choices in lattice:
            step: dict[str, tuple[float, str]] = {}
            for score, text in states.values():
                for letters, cost in choices:
                    cand = (score - cost + self._extended(text, letters), text + letters)
                    end = ("^^" + cand[1])[-2:]
                    if end not in step or cand > step[end]:
                        step[end] = cand
            states = step
        return max(((s + self._extended(t, "$"), t) for s, t in states.values()), default=(0.0, ""))[1]

    def hidden_reading(self, lattice: list[list[tuple[str, float]]], written: str) -> str | None:
        """The likeliest often hidden word among the readings, other than what is written; null if none is a reading.

        The states are the nodes of the tree of those words, so the pass is exact, however many readings there are.
        """
        states = {"": 0.0}
        for choices in lattice:
            step: dict[str, float] = {}
            for text, score in states.items():
                for letters, cost in choices:
                    to = text + letters
                    if to in _PREFIXES:
                        s = score - cost + self._extended(text, letters)
                        if s > step.get(to, -math.inf):
                            step[to] = s
            if not step:
                return None
            states = step
        # What is offensive by itself is hidden more often than what is by its context.
        ended = [(s + self._extended(t, "$") + 2.0 * (_STRONG_WORD.fullmatch(t) is not None) + 1.0 * (t in _INSULT_WORDS), t) for t, s in states.items() if t in _HIDDEN and t != written]
        return max(ended)[1] if ended else None


def _choices(ch: str, n: int, masked: bool) -> list[list[tuple[str, float]]]:
    """The lattice steps of a run of ``n`` equal written characters: what it may stand for, with costs."""
    if ch.isalpha():
        if n == 1:
            return [[(ch, 0.0)]]
        return [[(ch, 0.5 if n > 2 else 0.3), (ch * 2, 0.2 if n == 2 else 0.5)] + ([(ch * n, 6.0)] if n > 2 else [])]
    out: list[tuple[str, float]] = []
    if ch in STANDS_FOR:
        out += [(x * k, 1.0 + (k > 1)) for x in STANDS_FOR[ch] for k in ({1, 2} if n > 1 else {1})]
    if ch in MASKS and masked:
        # Each sign of a run hides a letter of its own; one by itself may only part letters.
        step = [(x, 3.0) for x in ALPHABET] + ([("", 1.0)] if n == 1 else [])
        return [step + [(x, 1.0) for x in STANDS_FOR.get(ch, "")]] * n
    if ch in SPACERS or ch in MASKS:
        out.append(("", 1.0))
    return [out or [("", 4.0)]]


_SPACED = re.compile(r"(?<![\w'’])(?:[^\W\d_][ ]){2,}[^\W\d_](?![\w'’])|(?<![\w'’])(?:[^\W_][-._*~]){3,}[^\W_]?(?!\w)")
_ODD = re.compile(
    r"(?<![\w@$])(?=[^\W\d_'’]*(?:[\d@$!|*#%_€£+?(]|--|-[^\W\d_]{1,3}(?!\w)|(?<![^\W\d_])[^\W\d_]{1,3}-[^\W\d_]|([^\W\d_])\1))[\w@$!|+*#%€£()?-]*(?:[\w@$*]|[#%]{2}|--)(?![\w@$])"
)
_DOUBLE = re.compile(r"([^\W\d_])\1")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_REPEATS = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1{2,}")
#: Words between equal runs of signs, which stress them.
_STRESSED = re.compile(r"([*#%_-]+)[^*#%_-]+\1")


def _suspicious(token: str) -> bool:
    core = token.strip("()?!-")
    if len(core) < 2:
        return False
    if _STRETCH.search(core) or (core.isalpha() and _DOUBLE.search(core)):
        return True
    letters = sum(c.isalpha() for c in core)
    leet = sum(c in STANDS_FOR and not c.isalpha() for c in core)
    masks = sum(c in "*_#%-" for c in core[1:])
    if core.isdigit() or re.fullmatch(r"[\d.,:%+-]+", core):
        return False
    if letters and re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", core):
        # Plain or hyphenated words; a single letter cut off by a hyphen may be a mask.
        return bool(re.search(r"(?:^|-)[^\W\d_]{1,2}-[^\W\d_]{1,3}$|^[^\W\d_]{1,3}-[^\W\d_]{1,2}(?:$|-)", core)) and core.count("-") == 1 and len(core) <= 9
    return bool((letters and (leet or masks)) or (leet >= 2 and any(c in "@$!|" for c in core)))


_CONTROL = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x20) if c not in (9, 10, 13)) + "]")
_INVISIBLE = re.compile("[" + "".join(chr(c) for c in (0xAD, 0x34F, 0x61C, 0x180E, 0x2800, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10))) + "]")
_FOREIGN = re.compile(r"[\u0250-\u02af\u0370-\u058f\u1d00-\u1dbf\ua720-\ua7ff]")
_TRUE_CYRILLIC = re.compile("[бдзлпцшщыэюяБДЗЛПЦШЩЫЭЮЯ]")
_RUN = re.compile(r"[^\W\d_]*[\u0250-\u02af\u0370-\u058f\u1d00-\u1dbf\ua720-\ua7ff][^\W\d_]*")


def normalise(text: str) -> str:
    """``text`` without invisible characters, in one script per word, and in composed small letters."""
    out = _CONTROL.sub("", text)
    if out.isascii():
        return out.lower()
    out = _INVISIBLE.sub("", unicodedata.normalize("NFKC", out))
    if _FOREIGN.search(out):
        true_cyrillic = bool(_TRUE_CYRILLIC.search(out))
        out = _RUN.sub(lambda m: _fold_run(m[0], true_cyrillic, not true_cyrillic), out)
    return out.lower()


def _lattice(core: str, stretched: bool) -> list[list[tuple[str, float]]]:
    lattice = []
    for m in re.finditer(r"(.)\1*", core, re.S):
        ch, n = m[1], len(m[0])
        # Double letters count as a stretch only where letters are stretched.
        lattice += [[(ch * 2, 0.0)]] if ch.isalpha() and n == 2 and not stretched else _choices(ch, n, True)
    return lattice


def _restore_token(word: str, model: CharModel) -> tuple[str, int]:
    """A written token as the word that it hides, and whether it hid one."""
    if word in model.words:
        return word, 0
    bare = word.strip("()?!")
    masked = bool(_MASK_RUN.search(bare)) and any(c.isalpha() for c in bare) and not _STRESSED.fullmatch(bare)
    if not masked and not _suspicious(word):
        return word, 0
    core = bare if masked else word.rstrip("?!-)").lstrip("(") if any(c in "!()" for c in word.strip("()?!-")) else word.strip("()?!-")
    if core in model.words or _STRESSED.fullmatch(core):
        return word, 0
    lattice = _lattice(core, bool(_STRETCH.search(core)) or core.isalpha())
    hidden = model.hidden_reading(lattice, core)
    if hidden:
        return word.replace(core, hidden), 1
    # No reading is shorter than the steps that need a letter; a longer one than the longest word is none.
    if (not core.isalpha() or _STRETCH.search(core)) and sum(all(x for x, _ in step) for step in lattice) <= model.longest:
        best = model.best_reading(lattice)
        if best != core and len(best) >= 3 and best in model.words:
            return word.replace(core, best), 0
    return word, 0


_MASK_RUN = re.compile(r"[*#%_-]{2,}")


def restore(text: str, model: CharModel) -> tuple[str, int]:
    """The text with hidden words restored, and how many there were. The text comes out normalised."""
    text = normalise(text)
    n = 0

    def spaced(m: re.Match) -> str:
        nonlocal n
        joined = re.sub(r"[ \-._*~]", "", m[0])
        lattice = [step for c in joined for step in _choices(c, 1, False)]
        best = joined if joined in _HIDDEN else model.hidden_reading(lattice, "") or model.best_reading(lattice)
        if best in model.words or best in _HIDDEN:
            n += 1
            return best + " " * m[0].endswith(" ")
        return m[0]

    def token(m: re.Match) -> str:
        nonlocal n
        word = m[0]
        known = model.restored.get(word)
        if known is None:
            if len(model.restored) > 200_000:
                model.restored.clear()
            known = model.restored[word] = _restore_token(word, model)
        n += known[1]
        return known[0]

    text = _SPACED.sub(spaced, text)
    return _ODD.sub(token, text), n


_HIDDEN = frozenset(HIDDEN_WORDS) | frozenset("faggot faggots nigger niggers tranny fuckers fuckin shits wankers pricks".split())
_PREFIXES = frozenset(w[:i] for w in _HIDDEN for i in range(len(w) + 1))
_STRONG_WORD, _INSULT_WORDS = re.compile(STRONG), frozenset(INSULTS)


# ---- the score of restored text ----------------------------------------------------------------------------------

KINDS = ("abuse", "hate", "sexual")
#: The model is fitted on passages of at most so many texts, those whose hashes come first, and as many generated sentences as the seeds give.
SAMPLE_TEXTS = 10_000
#: Of the passages that occur once and that the seeds say nothing about, one in so many is kept at first; others only if the first model errs on them, with the weight ``THIN``.
THIN = 4
SEED_WEIGHT = 0.3
SLOTS = 1 << 18
STEPS, RATE, DECAY, POSITIVE_WEIGHT = 40, 0.1, 1e-5, 10.0
#: The value of the feature that every passage has; large, so that what nothing speaks for falls to the rate of the sample.
BIAS = 5.0
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_RUNS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
# Words by which somebody is addressed, in the languages of the texts.
SECOND = frozenset("you your yours yourself youre you're ur tu te ti tus vous toi du dich dir dein deine deinen deinem deiner deines ihr ты тебя тебе твой твоя вы お前 貴様 تو".split())
#: Names of groups of people are one word to the model: what is said of one group is said of any.
_PEOPLE = re.compile(rf"\b(?:{GROUPS})\b")
_MARKS = re.compile(r"[“„«\"「‘]")


def tokens_of(text: str) -> list[str]:
    """The words of a text, numbers as one word; scripts without spaces give overlapping pairs of characters."""
    out: list[str] = []
    for w in _TOKEN.findall(_PEOPLE.sub(" somepeople ", text)):
        if w.isdigit():
            out.append("0")
        elif _RUNS.search(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def own_text(passage: str) -> tuple[str, bool]:
    """A passage without its lead and without what it quotes, and whether it quotes; empty if it is mostly a quotation."""
    p = _LEAD.sub("", passage)
    if not _MARKS.search(p):
        return ("", False) if p.strip(" .") == "" else (p, False)
    own = _QUOTED.sub(" ", p)
    return ("", True) if own.strip(" .") == "" or len(own) < len(p) * 0.25 else (own, len(own) != len(p))


@lru_cache(maxsize=500_000)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


@lru_cache(maxsize=200_000)
def _word_slots(word: str) -> list[int]:
    w = f"<{word}>"
    return [_slot("w" + word)] + [_slot("g" + w[i : i + 4]) for i in range(len(w) - 3)]


def features(own: str, quoting: bool) -> tuple[list[int], list[float]]:
    """The slots of a passage with their values: words with their letter runs, pairs of words, words where somebody is addressed."""
    words = tokens_of(own)
    second = not SECOND.isdisjoint(words)
    ids, vals = [_slot("bias")], [BIAS]
    if quoting:
        ids.append(_slot("quoting")), vals.append(1.0)
    for k, w in enumerate(words):
        slots = _word_slots(w)
        ids += slots
        vals += [1.0] + [1.0 / max(1, len(slots) - 1)] * (len(slots) - 1)
        if second:
            ids.append(_slot("s" + w)), vals.append(1.0)
        for gap in (1, 2):
            if k + gap < len(words):
                ids.append(_slot(f"p{gap}{w} {words[k + gap]}")), vals.append(1.0)
    return ids, vals


class Scorer:
    """A linear model for each kind over hashed features; what a word and a pair of words contribute is remembered."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.known: dict[str, tuple] = {}
        self.words: dict[str, tuple] = {}
        self.pairs: dict[tuple, tuple] = {}
        self.bias = tuple((BIAS * weights[_slot("bias")]).tolist())
        self.quoting = tuple(weights[_slot("quoting")].tolist())

    def _word(self, w: str) -> tuple:
        have = self.words.get(w)
        if have is None:
            if len(self.words) > 300_000:
                self.words.clear()
            slots = _word_slots(w)
            base = self.weights[slots[0]] + (self.weights[slots[1:]].sum(0) / max(1, len(slots) - 1) if len(slots) > 1 else 0.0)
            have = self.words[w] = (tuple(base.tolist()), tuple((base + self.weights[_slot("s" + w)]).tolist()))
        return have

    def _pair(self, key: tuple) -> tuple:
        have = self.pairs.get(key)
        if have is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            have = self.pairs[key] = tuple(self.weights[_slot(f"p{key[0]}{key[1]} {key[2]}")].tolist())
        return have

    def score(self, passage: str) -> tuple[float, float, float]:
        """The probabilities of the kinds, in the order of ``KINDS``."""
        have = self.known.get(passage)
        if have is None:
            if len(self.known) > 100_000:
                self.known.clear()
            have = self.known[passage] = self._score(passage)
        return have

    def _score(self, passage: str) -> tuple[float, float, float]:
        own, quoting = own_text(passage)
        if not own:
            return 0.0, 0.0, 0.0
        words = tokens_of(own)
        if not words:
            return 0.0, 0.0, 0.0
        second = not SECOND.isdisjoint(words)
        a, h, x = self.bias
        if quoting:
            a, h, x = a + self.quoting[0], h + self.quoting[1], x + self.quoting[2]
        n = len(words)
        for k, w in enumerate(words):
            t = self._word(w)[second]
            a, h, x = a + t[0], h + t[1], x + t[2]
            if k + 1 < n:
                t = self._pair((1, w, words[k + 1]))
                a, h, x = a + t[0], h + t[1], x + t[2]
                if k + 2 < n:
                    t = self._pair((2, w, words[k + 2]))
                    a, h, x = a + t[0], h + t[1], x + t[2]
        return tuple(1 / (1 + math.exp(-max(-40.0, min(40.0, v)))) for v in (a, h, x))


def fit_scorer(passages: list[tuple[str, tuple[float, float, float], float]]) -> np.ndarray:
    """The weights, ``SLOTS`` by kind, of a logistic regression on passages with labels between 0 and 1 and weights."""
    rows, ids, vals, labels, weights = [], [], [], [], []
    for passage, y, own_weight in passages:
        own, quoting = own_text(passage)
        if not own:
            continue
        i, v = features(own, quoting)
        rows.append(np.full(len(i), len(labels), np.int32))
        ids.append(np.asarray(i, np.int32)), vals.append(np.asarray(v, np.float32))
        labels.append(y), weights.append(own_weight)
    if not labels:
        return np.zeros((SLOTS, len(KINDS)), np.float32)
    r, i, v = np.concatenate(rows), np.concatenate(ids), np.concatenate(vals)
    used, i = np.unique(i, return_inverse=True)
    y, base = np.asarray(labels), np.asarray(weights)
    starts = np.searchsorted(r, np.arange(len(labels)))
    w = np.zeros((len(used), len(KINDS)))
    for k in range(len(KINDS)):
        wk, m1, m2 = w[:, k], np.zeros(len(used)), np.zeros(len(used))
        weight = base * np.where(y[:, k] >= 0.5, POSITIVE_WEIGHT, 1.0)
        for t in range(1, STEPS + 1):
            z = np.add.reduceat(v * wk[i], starts)
            err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[:, k])
            g = np.bincount(i, weights=v * err[r], minlength=len(used)) / base.sum() + DECAY * wk
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            wk -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    out = np.zeros((SLOTS, len(KINDS)), np.float32)
    out[used] = w
    return out


def passages_of(text: str | None, model: CharModel) -> tuple[list[str], int]:
    """The passages of a restored text, and the number of restored words."""
    if not text or not text.strip():
        return [], 0
    restored, n = restore(text, model)
    return _PASSAGE.split(restored), n


def document_score(text: str | None, model: CharModel, scorer: Scorer) -> tuple[float, str, int]:
    """The highest score of any passage, its kind (empty if below one half), and the number of restored words."""
    passages, n = passages_of(text, model)
    best, kind = 0.0, ""
    for passage in passages:
        for name, s in zip(KINDS, scorer.score(passage)):
            if s > best:
                best, kind = s, name
    return best, kind if best >= 0.5 else "", n


#: A word with at least this share of all words is a word of the decoder; there are at most 1 / share of them.
WORD_SHARE = 2e-6


def learn_model(documents: DataFrame, text: str = "text") -> CharModel:
    """The character model of all documents: trigram counts over a fixed alphabet (a bounded table) and the words in common use.

    The words are counted in one pass over the texts; a text that is copied counts once.
    """
    texts = documents.filter(F.col(text).isNotNull()).select(text).distinct()
    words = texts.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("w")).filter((F.length("w") >= 2) & F.col("w").rlike(f"^[{ALPHABET}]+$"))
    inside = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    padded = inside.select(F.concat(F.lit("^^"), "w", F.lit("$")).alias("p"), "n")
    grams = padded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring(F.col("p"), i, F.lit(3)))).alias("g"), "n")
    # The alphabet bounds the number of trigrams.
    trigrams = {r["g"]: float(r["n"]) for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    total = inside.agg(F.sum("n")).first()[0] or 0
    common = {r["w"] for r in inside.filter(F.col("n") >= max(3, math.ceil(total * WORD_SHARE))).select("w").collect()}
    # Hidden words are rare in the clear but likely behind a disguise.
    weight = max(1.0, total / 20_000)
    for w in HIDDEN_WORDS:
        p = f"^^{w}$"
        for i in range(len(p) - 2):
            trigrams[p[i : i + 3]] = trigrams.get(p[i : i + 3], 0.0) + weight
    return CharModel(trigrams, common)


def labelled_sample(documents: DataFrame, model: CharModel, text: str = "text", texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``p, n, y``: the distinct passages of at most ``texts`` texts, how many texts have them, and their weak labels. The sample is bounded whatever the data."""
    trigrams, words = model.trigrams, model.words

    def run(column: pd.Series) -> pd.Series:
        m = _worker_model(trigrams, words)
        return pd.Series([[(p, [round(v, 3) for v in seed_label(p).values()]) for p in dict.fromkeys(passages_of(t, m)[0])] for t in column], dtype=object)

    some = documents.filter(F.col(text).rlike(r"\S")).select(F.col(text).alias("t")).orderBy(F.xxhash64("t")).limit(texts)
    label = F.pandas_udf(run, "array<struct<p:string,y:array<double>>>")
    rows = some.repartition(2 * documents.sparkSession.sparkContext.defaultParallelism).select(F.explode(label("t")).alias("x"))
    return cut(rows.groupBy("x.p").agg(F.count(F.lit(1)).alias("n"), F.first("x.y").alias("y")))


def learn_scorer(documents: DataFrame, model: CharModel, text: str = "text") -> np.ndarray:
    """The weights of the scorer, from the labelled sample and the seed sentences; a second fit adds what the first one gets wrong."""
    sample = labelled_sample(documents, model, text)
    telling = F.array_max("y") >= 0.1
    first = telling | (F.col("n") > 1) | (F.pmod(F.xxhash64("p"), F.lit(THIN)) == 0)
    rows = sorted((r["p"], tuple(r["y"]), 1 + math.log(r["n"])) for r in sample.filter(first).collect())
    weights = fit_scorer(rows + seeds())
    run = _score_with(model.trigrams, model.words, weights, False)
    wrong = sample.filter(~first).select("p", "y", F.pandas_udf(run, "struct<score:double,kind:string,restored_words:int>")("p").alias("s")).filter("s.score > 0.2").select("p", "y").collect()
    if not wrong:
        return weights
    return fit_scorer(sorted(rows + [(r["p"], tuple(r["y"]), float(THIN)) for r in wrong]) + seeds())


def seeds() -> list[tuple[str, tuple[float, float, float], float]]:
    """The generated sentences with their labels. Half of them are abusive, so they weigh less than passages of the sample, which set the rate."""
    return [(s, tuple(y[k] for k in KINDS), SEED_WEIGHT) for s, y in seed_sentences() + pattern_sentences()]


def score_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, kind, restored_words`` for every row; ``kind`` is abuse, hate or sexual, null below one half.

    Null, empty and blank texts score 0. Every passage of a text counts, whatever its length. Repeated rows are scored each.
    """
    model = learn_model(documents, text)
    run = _score_with(model.trigrams, model.words, learn_scorer(documents, model, text))
    scored = parallel(documents.select(key, text), key).select(key, F.pandas_udf(run, "struct<score:double,kind:string,restored_words:int>")(text).alias("s"))
    return scored.select(key, F.round("s.score", 6).alias("score"), "s.kind", "s.restored_words")


def _score_with(trigrams: dict[str, float], words: set[str], weights: np.ndarray, whole: bool = True) -> Callable[[pd.Series], pd.DataFrame]:
    """What scores a batch of texts, or of restored passages if not ``whole``."""
    used = np.nonzero(weights.any(1))[0]
    compact, mark = weights[used], float(np.abs(weights).sum())

    def run(texts: pd.Series) -> pd.DataFrame:
        m = _worker_model(trigrams, words)
        if getattr(m, "mark", None) != mark:
            full = np.zeros((SLOTS, len(KINDS)), np.float32)
            full[used] = compact
            m.scorer, m.mark = Scorer(full), mark
        rows = [document_score(t, m, m.scorer) if whole else (max(m.scorer.score(t)), "", 0) for t in texts]
        return pd.DataFrame({"score": [r[0] for r in rows], "kind": [r[1] or None for r in rows], "restored_words": [r[2] for r in rows]})

    return run


_MODELS: list[tuple[int, CharModel]] = []


def _worker_model(trigrams: dict[str, float], words: set[str]) -> CharModel:
    if not _MODELS or _MODELS[0][0] != id(trigrams):
        _MODELS[:] = [(id(trigrams), CharModel(trigrams, words))]
    return _MODELS[0][1]


def rates_by_source(documents: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``source, documents, flagged, rate`` per source; documents without a source are under a null source."""
    scored = score_documents(documents, key, text)
    joined = documents.select(key, source).join(scored, key)
    return joined.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("rate"))
