"""Operator 4: quality rules with distribution divergence, in DataFrame functions only.

Fixed rules count words, symbols, repeated lines and repeated 3-word windows. The verdict compares
two histograms of a document with those of its language: character classes (lower, upper, digit,
beyond ASCII, other) and common words (the words of COMMON and all others). A language's reference is
the sum over its documents that pass the fixed rules. The Jensen-Shannon distance (base 2, 0 to 1) of
either histogram must not exceed its limit. The limit of common words is a share of the distance that a
text without any of them has from the language's reference, WORD_SHARE + WORD_NOISE / sqrt(words) of it:
short texts stray further by chance, and from MIN_WORDS words on the share is below 1. A language whose
reference has less than MIN_COMMON of common words (one that COMMON doesn't know) has the fixed
WORD_LIMIT. Guards: the histogram of characters is compared from
MIN_CHARS characters in words on, that of common words from MIN_WORDS words on, and a language with
fewer than MIN_REFERENCE words in its reference rejects nothing.

Edge cases: a null or empty text has no words and fails the fixed rules; a null language is one of
its own; repeated rows are judged each; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
# fixed values: frequent function words of English, German, French and Spanish
COMMON = ["the", "of", "and", "to", "in", "is", "that", "for", "der", "die", "und", "den", "von", "zu", "das", "mit", "le", "les", "des", "et", "un", "une", "pour", "dans", "el", "los", "las", "que", "una", "por", "con", "del"]
CHARACTER_LIMIT, WORD_LIMIT = 0.27, 0.40
WORD_SHARE, WORD_NOISE, MIN_COMMON = 0.7, 2.0, 0.05
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 200, 80, 1_000
#: Up to so many different repeated windows are looked up one by one; more are found by sorting.
FEW = 24


def _is(word: str):
    return lambda w: w == word


def _repeated_words() -> tuple[Column, Column, Column]:
    """Words in 3-word windows that occur twice or more, from `grams` (fingerprints of all windows)."""
    e = F.expr
    values = e("array_distinct(filter(sorted_grams, (x, i) -> x = get(sorted_grams, i + 1)))")
    few = e("filter(sequence(0, size(grams) - 1), i -> array_contains(repeated, get(grams, i)))")
    many = e("sort_array(transform(filter(pairs, (x, i) -> x.g = get(pairs, i - 1).g OR x.g = get(pairs, i + 1).g), x -> x.i))")
    return values, few, many


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the fixed rules' counts and the two histograms of each text; one pass, no shuffle."""
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    # the words are an array that later expressions share; Catalyst keeps it in a projection of its own
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("grams", F.expr("if(size(words) < 3, array(), transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))))"))
    d = d.withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("usual", F.transform(F.filter("words", lambda w: F.lower(w).isin(COMMON)), F.lower))
    length_without = lambda cls: F.length("text") - F.length(F.regexp_replace("text", cls, ""))
    kinds = [length_without(c) for c in ("[a-z]+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+")]
    d = d.select(
        "doc_id",
        "lang",
        "grams",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[k.cast("double") for k in kinds]).alias("kinds"),
        F.array(*[F.size(F.filter("usual", _is(c))).cast("double") for c in COMMON]).alias("usual"),
    )
    values, few, many = _repeated_words()
    d = d.withColumn("sorted_grams", F.expr("if(size(array_distinct(grams)) = size(grams), array(), sort_array(grams))"))
    d = d.withColumn("repeated", values)
    d = d.withColumn("pairs", F.expr(f"if(size(repeated) <= {FEW}, null, sort_array(transform(grams, (g, i) -> struct(g AS g, i AS i))))"))
    d = d.withColumn("at", F.when(F.size("repeated") == 0, F.expr("cast(array() AS array<int>)")).when(F.col("pairs").isNull(), few).otherwise(many))
    covered = F.expr("aggregate(at, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)")
    d = d.withColumn("n_repeat_words", covered).drop("grams", "sorted_grams", "repeated", "pairs", "at")
    d = d.withColumn("kinds", F.expr("concat(kinds, array(greatest(0D, word_chars - aggregate(kinds, 0D, (a, x) -> a + x))))"))
    d = d.withColumn("usual", F.expr("concat(usual, array(n_words - aggregate(usual, 0D, (a, x) -> a + x)))"))
    return d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _shares(h: str) -> Column:
    return F.expr(f"transform({h}, x -> x / greatest(1D, aggregate({h}, 0D, (a, y) -> a + y)))")


def jensen_shannon(p: str, q: str) -> Column:
    """The distance of two histograms that each sum to 1 (an empty one counts as all zeros)."""
    half = lambda x: f"if({x} > 0D, {x} * log2(2D * {x} / (a + b)), 0D)"
    return F.expr(f"sqrt(greatest(0D, 0.5D * aggregate(zip_with({p}, {q}, (a, b) -> {half('a')} + {half('b')}), 0D, (s, x) -> s + x)))")


def word_limits(word_limit: float) -> Column:
    """The limit of word_distance, from ref_usual and n_words."""
    none = f"array_append(array_repeat(0D, {len(COMMON)}), 1D)"
    share = WORD_SHARE + WORD_NOISE / F.sqrt(F.greatest("n_words", F.lit(1)))
    own = F.least(share * jensen_shannon(none, "ref_usual"), F.lit(word_limit))
    return F.when(F.element_at("ref_usual", -1) <= 1 - MIN_COMMON, own).otherwise(word_limit)


def references(found: DataFrame) -> DataFrame:
    """ref_lang, ref_words, ref_kinds, ref_usual: the summed histograms of each language."""
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    r = found.where("NOT base_failed").groupBy(F.col("lang").alias("ref_lang")).agg(F.sum("n_words").alias("ref_words"), sums("kinds", 5).alias("k"), sums("usual", len(COMMON) + 1).alias("u"))
    return r.select("ref_lang", "ref_words", _shares("k").alias("ref_kinds"), _shares("u").alias("ref_usual"))


def judged(docs: DataFrame, character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, the counts, base_failed, the two distances (null where a guard holds) and kept."""
    found = written(features(docs), "quality")
    d = found.join(references(found), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    d = d.withColumn("kinds", _shares("kinds")).withColumn("usual", _shares("usual"))
    known = F.coalesce(F.col("ref_words") >= MIN_REFERENCE, F.lit(False))
    d = d.withColumn("character_distance", F.when(known & (F.col("word_chars") >= MIN_CHARS), jensen_shannon("kinds", "ref_kinds")))
    d = d.withColumn("word_distance", F.when(known & (F.col("n_words") >= MIN_WORDS), jensen_shannon("usual", "ref_usual")))
    strange = (F.coalesce("character_distance", F.lit(0.0)) > character_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limits(word_limit))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~strange).alias("kept"), "character_distance", "word_distance")
