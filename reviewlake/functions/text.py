"""Scalar functions of the review data as column expressions (JVM side)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import udfs as U

# Sentinels of cells without an exploitable value.
NOT_FOUND, API_ERROR, REJECTED = "NON TROUVÉ", "ERREUR API", "CITATION REJETÉE"
SENTINELS = (NOT_FOUND, API_ERROR, REJECTED)


def c(value: Column | str) -> Column:
    """A column by name or as it is."""
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Without outer white space."""
    return F.regexp_replace(c(value), r"^\s+|\s+$", "")


def nonblank(value: Column | str) -> Column:
    """The stripped value; null if nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def _either(value: Column | str, plain: Callable[[Column], Column], exact: Callable[..., Column]) -> Column:
    """``plain`` in the JVM for ASCII text, ``exact`` in an Arrow UDF for other text. ASCII texts travel to it as nulls; a null is the empty string."""
    v = F.coalesce(c(value), F.lit(""))
    odd = v.rlike(r"[^\x00-\x7f]")
    return F.when(odd, exact(F.when(odd, v))).otherwise(plain(v))


#: White space of ASCII text.
SPACE = r"[\s\x1c-\x1f]"


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_title(title: Column | str) -> Column:
    """NFKC, case-folded, every run of other characters than letters and digits as one space. Null is the empty string."""
    return _either(title, lambda v: F.trim(F.regexp_replace(F.lower(v), r"[^a-z0-9]+", " ")), U.normalize_title_exact)


def normalize_identity_title(title: Column | str) -> Column:
    """Like :func:`normalize_title`, but the underscore counts as a letter."""
    return _either(title, lambda v: F.trim(F.regexp_replace(F.lower(v), r"[^a-z0-9_]+", " ")), U.identity_title_exact)


def normalize_evidence(text: Column | str) -> Column:
    """NFKC, without soft hyphens, words joined over line ends, white space collapsed; case and punctuation stay."""
    return _either(text, lambda v: _collapsed(F.regexp_replace(v, r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)", "")), U.evidence_exact)


def citation_is_verifiable(citation: Column | str, text: Column | str) -> Column:
    """Whether the citation, not empty, stands in the text."""
    quote = normalize_evidence(citation)
    return (F.length(quote) > 0) & F.contains(normalize_evidence(text), quote)


def normalize_span(text: Column | str) -> Column:
    """NFKC, case-folded, straight quotes, escapes of markup undone, ``~`` as a space, white space collapsed."""
    return _either(text, lambda v: _collapsed(F.replace(F.regexp_replace(F.lower(v), r"\\([%&_#])", "$1"), F.lit("~"), F.lit(" "))), U.span_exact)


def collapse_space(text: Column | str) -> Column:
    """NFKC, white space collapsed, nothing else."""
    return _either(text, _collapsed, U.spaced_exact)


def sanitize_delimiters(text: Column | str) -> Column:
    """Prompt delimiters made harmless."""
    out = F.replace(F.coalesce(c(text), F.lit("")), F.lit("<<<"), F.lit("< < <"))
    return F.replace(out, F.lit(">>>"), F.lit("> > >"))


def clean_doi(doi: Column | str) -> Column:
    """Without the resolver address; null is the empty string."""
    return F.replace(F.coalesce(c(doi), F.lit("")), F.lit("https://doi.org/"), F.lit(""))


def canonical_doi(doi: Column | str) -> Column:
    """Stripped, in small letters; null is the empty string."""
    return F.lower(strip(F.coalesce(c(doi), F.lit(""))))


def normalize_identity_doi(doi: Column | str) -> Column:
    """Stripped, small letters, without one leading address or label, without trailing dots and spaces."""
    out = F.regexp_replace(canonical_doi(doi), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")
    return F.regexp_replace(out, r"[ .]+$", "")


def safe_document_filename(kind: Column | str, value: Column | str) -> Column:
    """A file name for an identity: DOIs with ``_`` for ``/``; others readable, shortened, with a hash."""
    v = c(value)
    readable = F.regexp_replace(F.regexp_replace(v, r'[<>:"/\\|?*\s]', "_"), r"[. ]+$", "")
    other = F.concat(c(kind), F.lit("_"), F.substring(readable, 1, 100), F.lit("_"), F.substring(F.sha2(v, 256), 1, 12))
    return F.when(c(kind) == "doi", F.replace(v, F.lit("/"), F.lit("_"))).otherwise(other)


def pmcid_of_url(url: Column | str) -> Column:
    """The PMC number of an article address; null for other addresses."""
    found = F.regexp_extract(strip(url), r"^https?://(?:pmc\.ncbi\.nlm\.nih\.gov|www\.ncbi\.nlm\.nih\.gov/pmc)/articles/(PMC[0-9]+)(?:/pdf)?/?$", 1)
    return F.nullif(found, F.lit(""))


def first_doi_token(*fields: Column | str) -> Column:
    """The first DOI-looking token over the fields in order, without trailing punctuation; null if there is none."""
    tokens = [F.nullif(F.regexp_replace(F.regexp_extract(c(f), r"(?i)(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;:)\]]+$", ""), F.lit("")) for f in fields]
    return F.coalesce(*tokens)


def first_url(*fields: Column | str) -> Column:
    """The first http(s) value over the fields in order."""
    return F.coalesce(*[F.when(strip(f).rlike(r"^https?://"), strip(f)) for f in fields])


def strip_tags(text: Column | str) -> Column:
    """Without tags, the five basic entities as characters, white space collapsed."""
    out = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: White space of any text, as a class of characters.
ANY_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def segment_sentences(text: Column | str) -> Column:
    """The sentences of a text: cut after ``.!?`` before a capital or ``<``, not after i.e., e.g. and etc.; stripped, without empty ones."""
    trim = lambda v: F.regexp_replace(v, rf"^{ANY_SPACE}+|{ANY_SPACE}+$", "")
    parts = F.split(trim(c(text)), rf"(?<=[.!?])(?<!\b(?i:i\.e\.|e\.g\.|etc\.)){ANY_SPACE}+(?=[A-Z<])")
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def sentence_records(text: Column | str) -> Column:
    """The sentences numbered S1, S2, ..."""
    return F.transform(segment_sentences(text), lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("source"), x.alias("text")))


def user_message(title: Column | str, sentences: Column | str) -> Column:
    """The text that a case is put to a model in: title and numbered sentences, one a line, between document marks; such marks inside are made harmless."""
    safe = lambda v: F.replace(F.replace(v, F.lit("<DOCUMENT>"), F.lit("<DOC>")), F.lit("</DOCUMENT>"), F.lit("</DOC>"))
    lines = F.transform(c(sentences), lambda x: F.concat(x["source"], F.lit(": "), safe(x["text"])))
    head = F.concat(F.lit("T: "), safe(F.coalesce(c(title), F.lit(""))))
    return F.array_join(F.concat(F.array(F.lit("<DOCUMENT>"), head), lines, F.array(F.lit("</DOCUMENT>"))), "\n")


def recovered_texts(retrieved: Column, assessed: Column, failed: Column) -> Column:
    """How many texts were had: the count if there is one, else what was tried less what failed."""
    return F.coalesce(retrieved, F.greatest(F.lit(0), F.coalesce(assessed, F.lit(0)) - F.coalesce(failed, F.lit(0))))


def run_stamp(now: Column | None = None) -> Column:
    """The name of a run: a UTC time down to microseconds."""
    return F.date_format(F.current_timestamp() if now is None else now, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def parse_year(year: Column | str) -> Column:
    """A year from 1900 to 2099 that is all of the value; else null."""
    return F.when(strip(year).rlike(r"^(19|20)\d{2}$"), strip(year).cast("int"))


def parse_count(value: Column | str) -> Column:
    """A non-negative whole number written in digits; else null."""
    return F.when(strip(value).rlike(r"^\d{1,18}$"), strip(value).cast("long"))


def parse_score(value: Column | str) -> Column:
    """A score clamped to 0..1; null for what is no number."""
    number = F.when(strip(value).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), strip(value).cast("double"))
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def decide(score: Column | str, include_at: float = 0.75, exclude_at: float = 0.25) -> Column:
    """Three-way routing, both ends inclusive; a null score needs a human."""
    s = c(score)
    return F.when(s.isNull(), "needs_manual").when(s >= include_at, "include").when(s <= exclude_at, "exclude").otherwise("needs_manual")


def exploitable(value: Column | str) -> Column:
    """Whether a cell holds a value: not blank and no sentinel."""
    v = strip(value)
    return F.coalesce((v != "") & ~v.isin(*SENTINELS), F.lit(False))


def cell_state(value: Column | str) -> Column:
    """What an extraction cell holds: value, not_found, api_error, rejected or blank."""
    v = strip(F.coalesce(c(value), F.lit("")))
    return F.when(v == "", "blank").when(v == NOT_FOUND, "not_found").when(v == API_ERROR, "api_error").when(v == REJECTED, "rejected").otherwise("value")


def reconstruct_abstract(inverted: Column | str) -> Column:
    """The text of an inverted index (word to positions); of two words at one position the later one by name wins."""
    flat = F.flatten(F.transform(F.map_entries(c(inverted)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(flat)
    following = F.concat(F.slice(ordered, 2, 1 << 30), F.array(F.lit(None).cast("struct<p:int,w:string>")))
    paired = F.zip_with(ordered, following, lambda x, y: F.struct(x["p"].alias("p"), x["w"].alias("w"), y["p"].alias("next")))
    last = F.filter(paired, lambda x: x["next"].isNull() | (x["next"] != x["p"]))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields in the order of their names; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def cut(text: Column | str, most: int) -> Column:
    """At most so many characters."""
    return F.substring(c(text), 1, most)
