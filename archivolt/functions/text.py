"""Text functions as Column expressions; all stay inside generated code.

Word characters are Unicode letters, digits and the underscore, written out as
classes, since the short class of Java patterns is ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s]"
#: Ligatures and what they stand for; fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """Runs of white space made one blank, outer blanks removed."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def normalize_surface(x: Column | str) -> Column:
    """Lower case without punctuation, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(_c(x)), NOT_WORD_OR_SPACE, ""))


normalize_term = normalize_surface


def norm_key(x: Column | str) -> Column:
    """A look-up key that keeps apostrophes, drops periods, makes other marks blanks and a last ``u`` ``us``."""
    low = F.regexp_replace(F.lower(_c(x)), r"\.", "")
    return F.regexp_replace(collapse(F.regexp_replace(low, r"[^\p{L}\p{N}_'\s]", " ")), r" u$", " us")


def normalize_fts(x: Column | str, version: str = "norm_v2") -> Column:
    """norm_v1 is the text itself; norm_v2 opens ligatures, joins words broken over lines and collapses white space."""
    if version == "norm_v1":
        return _c(x)
    if version != "norm_v2":
        raise ValueError(f"unknown normalisation {version!r}")
    opened = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), _c(x))
    return collapse(F.regexp_replace(opened, r"([\p{L}\p{N}_])-\s*\r?\n\s*([\p{L}\p{N}_])", "$1$2"))


def variant_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def valid_surface(x: Column | str, least: int = 3, stop: tuple[str, ...] = ("the", "and", "for", "with")) -> Column:
    """Long enough, with a letter, and no stop word."""
    return (F.length(_c(x)) >= least) & _c(x).rlike(r"\p{L}") & ~F.lower(_c(x)).isin(*stop)


def tokens(x: Column | str) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(_c(x)), NOT_WORD), lambda t: t != "")


def lexemes(x: Column | str) -> Column:
    """Distinct lower-case words, the document side of full-text matching."""
    return F.array_distinct(tokens(x))


def has_term(words: Column | str, term: str) -> Column:
    return F.array_contains(_c(words), term.lower())


def has_prefix(words: Column | str, prefix: str) -> Column:
    return F.exists(_c(words), lambda t: F.startswith(t, F.lit(prefix.lower())))


def has_phrase(words: Column | str, phrase: str) -> Column:
    """The words of the phrase next to each other; an empty phrase matches nothing."""
    want = [w for w in phrase.lower().split() if w]
    if not want:
        return F.lit(False)
    w = _c(words)
    if len(want) == 1:
        return F.array_contains(w, want[0])
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - len(want) + 1, F.lit(1)))
    return (F.size(w) >= len(want)) & F.array_contains(w, want[0]) & F.exists(starts, lambda i: F.slice(w, i, len(want)) == F.array(*map(F.lit, want)))


def count_phrase(words: Column | str, phrase: str) -> Column:
    """How often a word or the words of a phrase stand next to each other; an empty phrase counts nothing."""
    want = [w for w in phrase.lower().split() if w]
    w = _c(words)
    if not want:
        return F.lit(0)
    if len(want) == 1:
        return F.size(F.filter(w, lambda t: t == want[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - len(want) + 1, F.lit(1)))
    return F.when(F.size(w) >= len(want), F.size(F.filter(starts, lambda i: F.slice(w, i, len(want)) == F.array(*map(F.lit, want))))).otherwise(0)


def places(words: Column | str, term: str) -> Column:
    """Places (from 1) of a word among the words."""
    return F.filter(F.transform(_c(words), lambda t, i: F.when(t == term.lower(), i + 1)), lambda p: p.isNotNull())


def min_distance(words: Column | str, a: str, b: str) -> Column:
    """The smallest number of words from one term to another; null where one is missing."""
    pa, pb = places(words, a), places(words, b)
    return F.array_min(F.flatten(F.transform(pa, lambda x: F.transform(pb, lambda y: F.abs(x - y)))))


def term_score(words: Column | str, terms: list[str]) -> Column:
    """A rank for matches: occurrences of the terms, each damped by the logarithm of the text's words."""
    count = lambda q: F.size(F.filter(_c(words), lambda t: t == q.lower()))
    hits = reduce(Column.__add__, map(count, terms), F.lit(0))
    return F.round(hits / (1 + F.log(1 + F.size(_c(words)))), 6)


def headline(words: Column | str, term: str, before: int = 7, size: int = 15) -> Column:
    """A run of words around the first match; null without one."""
    at = F.array_position(_c(words), term.lower())
    return F.when(at > 0, F.array_join(F.slice(_c(words), F.greatest(at - before, F.lit(1)).cast("int"), F.lit(size)), " "))


def preview(text: Column | str, n: int = 160) -> Column:
    return F.left(collapse(text), F.lit(n))


def trigrams(x: Column | str) -> Column:
    """Distinct three-letter pieces of the lower-case words, padded with two blanks before and one after."""
    grams = F.transform(tokens(x), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two arrays of distinct entries; 0 for two empty ones."""
    both = F.size(F.array_intersect(_c(a), _c(b)))
    return F.round(F.coalesce(both / F.nullif(F.size(_c(a)) + F.size(_c(b)) - both, F.lit(0)), F.lit(0.0)), 6)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def word_similarity(term: str, text: Column | str) -> Column:
    """The best trigram similarity of the term to any word of the text."""
    return F.coalesce(F.array_max(F.transform(lexemes(text), lambda w: trigram_similarity(F.lit(term), w))), F.lit(0.0))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    return jaccard(lexemes(a), lexemes(b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null where one has no direction or they differ in length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    x, y = _c(a), _c(b)
    return F.when(F.size(x) == F.size(y), dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0)))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: F.pow(p.cast("double") - q, F.lit(2))), F.lit(0.0), lambda s, v: s + v))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)


def hash_embedding(words: Column | str, size: int = 32) -> Column:
    """Counts of the words by hash bucket, a vector that needs no model."""
    buckets = F.transform(_c(words), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("float"))


def ratio(x: Column | str, kind: str) -> Column:
    """Share of the characters that are of a class; 0 for an empty text."""
    kept = F.length(F.regexp_replace(_c(x), f"[^{kind}]", ""))
    return F.round(F.coalesce(kept / F.nullif(F.length(_c(x)), F.lit(0)), F.lit(0.0)), 6)


def quality(x: Column | str) -> Column:
    """A struct of what tells scanned text from clean text."""
    return F.struct(
        ratio(x, r"A-Za-z").alias("letters"), ratio(x, r"AEIOUaeiou").alias("vowels"), ratio(x, r"A-Z").alias("capitals"), ratio(x, r"0-9").alias("digits"),
        _c(x).rlike(r"(\p{L})\1\1").alias("repeats"), F.length(_c(x)).alias("length"),
    )


def quality_class(x: Column | str) -> Column:
    """``clean``, ``ocr`` or ``unknown`` for texts too short to tell."""
    return F.when(F.coalesce(F.length(_c(x)), F.lit(0)) < 40, "unknown").when((ratio(x, "A-Za-z") >= 0.7) & ~_c(x).rlike(r"[~^|_·]"), "clean").otherwise("ocr")


def acronym(x: Column | str) -> Column:
    return F.upper(F.array_join(F.transform(tokens(x), lambda w: F.left(w, F.lit(1))), ""))


def surname(x: Column | str) -> Column:
    return F.try_element_at(tokens(x), F.lit(-1))


def name_key(x: Column | str, stop: tuple[str, ...] = ("mr", "mrs", "dr", "prof", "col", "capt", "lt", "comrade", "the", "of")) -> Column:
    """The words of a name in alphabetical order without titles."""
    return F.array_join(F.array_sort(F.array_except(tokens(x), F.array(*map(F.lit, stop)))), " ")


def lines(x: Column | str) -> Column:
    return F.split(_c(x), "\n")


def clean_lines(x: Column | str, least: float = 0.5) -> Column:
    """The text without lines that are mostly not letters."""
    return F.array_join(F.filter(lines(x), lambda line: ratio(line, r"\p{L}\s") >= least), "\n")


def set_hash(x: Column | str) -> Column:
    """md5 of the sorted distinct ids of an array, joined by bars."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.array_distinct(_c(x))), lambda v: v.cast("string")), "|").cast("binary"))


def canonical_hash(x: Column | str) -> Column:
    """sha256 of a text's normal form."""
    return F.sha2(normalize_surface(x).cast("binary"), 256)


def keywords(x: Column | str) -> Column:
    """Capitalised words of at least four letters, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"([A-Z][a-z]{3,})"), F.lit(1))))


def sentences(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def contexts(x: Column | str, term: str, around: int = 20) -> Column:
    """Every non-overlapping occurrence of a term with up to ``around`` characters on each side."""
    return F.regexp_extract_all(_c(x), F.lit(f"(?s)(.{{0,{around}}}{term}.{{0,{around}}})"), F.lit(1))
