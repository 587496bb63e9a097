"""Quality by distribution divergence (operator 7), in DataFrame functions alone.

A document's character-class and common-word histograms are compared with references of the languages of the corpus by
Jensen-Shannon distance. The references come from two counting passes over all documents: word counts in
hash buckets, then exact counts of the words in heavy buckets. A common word has at least
MIN_SHARE of its language's words. A language with MIN_WORDS words, or in small tables LANGUAGE_SHARE of all, has
a reference, at most the 1 / LANGUAGE_SHARE largest: so the references have at most 1 / MIN_SHARE words for each of
1 / LANGUAGE_SHARE languages, however large the corpus: that is what goes to the driver and into the plan.
A document whose own language has no reference is not judged by distance. Scoring is then a projection: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import WORD_GAP, stored

GAP_CHARS = " \t\n\x0b\f\r"
CLASSES = ("lower", "gap", "upper", "digit", "point", "other_letter", "symbol")
#: Taken off one after another; what is left after the last is the class symbol.
CLASS_PATTERNS = ("[a-z]+", WORD_GAP, "[A-Z]+", "[0-9]+", "[.,;:!?'\"()\\-]+", "[^\\x00-\\x7F]+")
BUCKETS, WINDOW = 1 << 16, 8
MIN_SHARE, LANGUAGE_SHARE = 0.002, 0.02
#: Words of a language that make its histogram stable: a common word then occurs ten times at least.
MIN_WORDS = 5000


@dataclass
class Limits:
    """Verdict: a distance above its limit fails a document that is long enough for it."""

    char_distance: float = 0.32
    word_distance: float = 0.375
    min_chars: int = 200
    min_words: int = 60


@dataclass
class References:
    """By language: shares of the character classes and of the common words (the rest of 1 is all other words)."""

    classes: dict[str, list[float]] = field(default_factory=dict)
    words: dict[str, dict[str, float]] = field(default_factory=dict)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: lambda variables are bound, columns inside a lambda are computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    inner = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def class_counts(text: Column) -> Column:
    """Code points of each of CLASSES, one array."""
    def step(rest: Column, left: tuple[str, ...], counts: list[Column]) -> Column:
        if not left:
            return F.array(*counts, F.length(rest).cast("long"))
        return let(F.regexp_replace(rest, left[0], ""), lambda less: step(less, left[1:], [*counts, (F.length(rest) - F.length(less)).cast("long")]))

    return step(text, CLASS_PATTERNS, [])


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of window words that the text has twice or more; the first copy counts too.

    Windows are compared by 64-bit hashes; only a text that has a repeated one pays for the positions.
    """
    def covered(marks: Column) -> Column:
        again = lambda j: (F.get(marks, j)["h"] == F.get(marks, j - 1)["h"]) | (F.get(marks, j)["h"] == F.get(marks, j + 1)["h"])
        hit = F.filter(F.sequence(F.lit(0), F.size(marks) - 1), lambda j: F.coalesce(F.get(marks, j)["h"] == F.get(marks, j + 1)["h"], F.lit(False)) | F.coalesce((j > 0) & again(j), F.lit(False)))
        starts = F.array_sort(F.transform(hit, lambda j: F.get(marks, j)["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda acc, x: acc + x))

    def of(hashes: Column) -> Column:
        marks = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(marks, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(hashes, of))


def duplicate_lines(text: Column) -> Column:
    """\\n-split lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(GAP_CHARS))) > 0)
    return let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long"))


def build_references(docs: DataFrame, min_share: float = MIN_SHARE, language_share: float = LANGUAGE_SHARE, min_words: int = MIN_WORDS) -> References:
    """References of the languages in docs.lang, from all its texts. Rows without a language or words give nothing; an empty table gives no references."""
    named = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    each = named.select("lang", F.explode(word_array(F.col("text"))).alias("word"))
    # Written, as it is read twice: for each language its words, and the buckets that can hold a common word, of which there are at most 1 / min_share.
    buckets = stored(each.groupBy("lang", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n")), "word-buckets")
    by_bucket = buckets.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r["lang"]: r["total"] for r in by_bucket.orderBy(F.desc("total"), "lang").limit(math.ceil(1 / language_share)).collect()}
    whole = sum(totals.values())
    totals = {k: n for k, n in totals.items() if n >= min(min_words, language_share * whole)}
    out = References()
    if not totals:
        return out
    enough = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min_share * n)) for k, n in totals.items()])
    heavy = buckets.where(F.col("lang").isin(list(totals))).where(F.col("n") >= enough).select("lang", "b").collect()
    held = F.lit(False)
    for k in totals:
        held |= (F.col("lang") == k) & F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).isin([r["b"] for r in heavy if r["lang"] == k])
    common = each.where(held).groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    for r in common.collect():
        out.words.setdefault(r["lang"], {})[r["word"]] = r["n"] / totals[r["lang"]]
    sums = named.where(F.col("lang").isin(list(totals))).select("lang", class_counts(F.col("text")).alias("c"))
    for r in sums.groupBy("lang").agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(len(CLASSES))]).alias("c")).collect():
        out.classes[r["lang"]] = [x / max(1, sum(r["c"])) for x in r["c"]]
    return out


def _half(p: Column, q: Column) -> Column:
    """What one category adds to twice the divergence in bits."""
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return term(p) + term(q)


def class_distance(counts: Column, reference: list[float]) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    parts = let(total, lambda n: sum((_half(F.get(counts, F.lit(i)) / n, F.lit(float(q))) for i, q in enumerate(reference)), F.lit(0.0)))
    return F.sqrt(F.greatest(parts / 2, F.lit(0.0)))


def word_histogram(words: Column, common: list[str]) -> Column:
    """(w, c) of the common words in words: sorted runs, so that the cost does not depend on how many references there are."""
    found = F.array_sort(F.filter(words, lambda w: w.isin(common)))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(st, lambda x, j: F.struct(F.get(s, x).alias("w"), (F.coalesce(F.get(st, j + 1), F.size(s)) - x).alias("c"))))

    return let(found, lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<w:string,c:int>>")).otherwise(runs(s)))


def word_distance(histogram: Column, n_words: Column, reference: dict[str, float]) -> Column:
    """Over the reference's words and one category for all others."""
    table = F.create_map(*[x for w, q in sorted(reference.items()) for x in (F.lit(w), F.lit(float(q)))])

    def add(acc: Column, e: Column) -> Column:
        return let(F.try_element_at(table, e["w"]), lambda q: F.when(q.isNull(), acc).otherwise(
            let(e["c"] / n_words, lambda p: F.struct((acc["s"] + _half(p, q)).alias("s"), (acc["p"] + p).alias("p"), (acc["q"] + q).alias("q")))))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    rest_q = max(0.0, 1.0 - sum(reference.values()))
    finish = lambda a: a["s"] + (F.lit(float(sum(reference.values()))) - a["q"]) + _half(F.greatest(1 - a["p"], F.lit(0.0)), F.lit(rest_q))
    return F.sqrt(F.greatest(F.aggregate(histogram, start, add, finish) / 2, F.lit(0.0)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def measures(text: Column, refs: References, limits: Limits | None = None, lang: Column | None = None) -> Column:
    """A struct of MEASURES for a text, as one expression: whatever Catalyst moves, each part is computed once a row.

    Distances are the least over the languages; null where there are no references or the text is
    shorter than the guards (min_chars, min_words), or where lang, if given, has no reference of its own (a null
    lang is judged by all), and then they do not fail a document. A null text has no
    words: all counts 0, base_failed, not kept.
    """
    limits = limits or Limits()
    common = sorted({w for ref in refs.words.values() for w in ref})
    none = F.lit(None).cast("double")
    judged = F.lit(True) if lang is None else F.coalesce(lang.cast("string").isin(list(refs.classes)), F.lit(True))
    least = lambda v: F.least(*v) if len(v) > 1 else (v[0] if v else none)

    def of(t: Column, words: Column, classes: Column) -> Column:
        n = F.size(words).cast("long")
        by_class = F.when(judged & (F.length(t) >= limits.min_chars), least([class_distance(classes, q) for _, q in sorted(refs.classes.items())])).otherwise(none)
        by_word = let(word_histogram(words, common), lambda h: least([word_distance(h, n, q) for _, q in sorted(refs.words.items())])) if common else none
        by_word = F.when(judged & (n >= limits.min_words), by_word).otherwise(none)
        symbols = F.when(F.get(classes, F.lit(6)) == 0, F.lit(0)).otherwise(F.regexp_count(t, F.lit("[#*$%&|<>]"))).cast("long")

        def verdict(repeats: Column, dc: Column, dw: Column) -> Column:
            failed = (n < 20) | (100 * repeats > 30 * n)
            far = F.coalesce(dc > limits.char_distance, F.lit(False)) | F.coalesce(dw > limits.word_distance, F.lit(False))
            values = (n, (F.length(t) - F.get(classes, F.lit(1))).cast("long"), symbols, duplicate_lines(t), repeats, failed, dc, dw, ~failed & ~far)
            return F.struct(*[v.alias(k) for k, v in zip(MEASURES, values, strict=True)])

        return let(repeated_words(words), lambda r: let(by_class, lambda dc: let(by_word, lambda dw: verdict(r, dc, dw))))

    whole = F.coalesce(text.cast("string"), F.lit(""))
    return let(whole, lambda t: let(word_array(t), lambda w: let(class_counts(t), lambda c: of(t, w, c))))


def kept(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs, with their own columns, that the rules keep, against references of all docs."""
    return docs.where(measures(F.col("text"), build_references(docs), limits, F.col("lang"))["kept"])


def quality(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id with the counts, distances and verdict of measures(), against references of all docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text"), build_references(docs), limits, F.col("lang")).alias("m"))
    return rows.select("doc_id", *[f"m.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")])
