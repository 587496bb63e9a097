"""Search text, display terms and concordances as column expressions; what depends on the query alone is plain Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts whose characters are indexed one by one.
CJK_RANGES = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uFF66-\\uFF9F"
CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
# Combining marks that vanish inside a word; every other one ends it.
SILENT_MARKS = [*range(0x0300, 0x0305), *range(0x0306, 0x030D), 0x030F, 0x0311, 0x031B, *range(0x0323, 0x0329), 0x032D, 0x032E, 0x0330, 0x0331]
# Letters folded by exception.
FOLD_EXCEPTIONS = {"ſ": "s", "ẛ": "s", "µ": "μ", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}
DISPLAY_OPERATORS = {"AND", "OR", "NOT", "NEAR"}
TERM_EDGE = "\"()[]{}*:^~+,.!?;\\"  # fixed value: what is taken off the ends of a display term
MAX_QUERY, KWIC_MOST, KWIC_WIDTH, HIGHLIGHTS_MOST = 300, 5, 60, 200
LABELS = {"zh": "中", "ja": "日", "en": "英"}


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """From and to strings for translate: a letter folds if its lower case is one ASCII letter and one mark. Marks to drop stand at the end of from."""
    pairs = dict(FOLD_EXCEPTIONS)
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        low = chr(cp).lower()
        parts = unicodedata.normalize("NFD", low)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and unicodedata.combining(parts[1]):
            pairs.setdefault(low, parts[0])
            pairs.setdefault(chr(cp), parts[0])
    return "".join(pairs) + "".join(map(chr, SILENT_MARKS)), "".join(pairs.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: a column inside a lambda is computed for each element, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed_lines(c: Column) -> Column:
    """The lines of two characters or more, without blanks at their ends. trim stands in a lambda: F.transform gives a function of two parameters the place as well, whose digits trim would take off."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)


def cjk_space(c: Column) -> Column:
    """A space on both sides of every character of the scripts that are indexed one by one."""
    return F.regexp_replace(c, f"([{CJK_RANGES}])", " $1 ")


def tokens(c: Column) -> Column:
    """Folded words. ASCII text, which has nothing to space or fold, goes a shorter way with the same result."""
    source, target = fold_table()
    text = F.coalesce(c, F.lit(""))
    words = lambda x, chars: F.regexp_extract_all(x, F.lit(f"[{chars}]+"), F.lit(0))
    return F.when(F.length(text) == F.octet_length(text), words(F.lower(text), "a-z0-9")).otherwise(words(F.translate(F.lower(cjk_space(text)), source, target), "\\p{L}\\p{N}\\p{Co}"))


def token_text(c: Column) -> Column:
    """The search column: tokens with one space between and around them, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


def phrase_texts(query: str) -> list[str]:
    """The phrases a query asks for. With a CJK character it is one phrase; else each word is, a quoted span too (its quotes would be an error in the reference grammar)."""
    q = (query or "").strip()
    if not q:
        return []
    if CJK.search(q):
        return [q.replace('"', " ")]
    return [(a or b).replace('"', " ").strip() for a, b in re.findall(r'"([^"]+)"|(\S+)', q) if (a or b).strip('" ')] or [q]


def may_match(content: Column, query: str) -> Column:
    """A cheap test that every text passes which matches(): it holds the query's ASCII words after folding. Worth it where the tokens are not stored."""
    source, target = fold_table()
    text = F.lower(F.coalesce(content, F.lit("")))
    folded = F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, source, target))
    keep = F.lit(True)
    for word in sorted({w for p in phrase_texts(query) if p.isascii() for w in re.findall("[a-z0-9]+", p.lower())}, key=lambda w: (-len(w), w)):
        keep = keep & F.contains(folded, F.lit(word))
    return keep


def matches(tok: Column, query: str) -> Column:
    """Rows that hold every phrase. A phrase without tokens, like & or ***, empties the result."""
    keep = F.lit(bool(phrase_texts(query)))
    for phrase in phrase_texts(query):
        wanted = token_text(F.lit(phrase))
        keep = keep & (F.length(F.trim(wanted)) > 0) & F.contains(tok, wanted)
    return keep


def display_terms(query: str) -> list[str]:
    """What to mark in a text: quoted spans, then words without operators; CJK queries as they are; each once, whatever its case."""
    q = (query or "")[:MAX_QUERY].strip()
    spans = re.findall(r'"([^"\r\n]+)"', q)
    rest = re.sub(r'"[^"\r\n]+"', " ", q).split()
    bare = lambda t: t.strip(TERM_EDGE).strip()
    if CJK.search(q) and not spans and not any(w.upper() in DISPLAY_OPERATORS for w in rest):
        found = [bare(q)]
    else:
        found = [t.strip() for t in spans] + [t for t in map(bare, rest) if t.upper() not in DISPLAY_OPERATORS]
    return list({t.casefold(): t for t in reversed(found) if t}.values())[::-1]


def java_literal(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" or ord(ch) > 127 else "\\" + ch for ch in text)


def display_pattern(query: str) -> str | None:
    """A Java pattern for the terms, longest first; words are bounded where they begin or end in a word character."""
    def one(term: str) -> str:
        if CJK.search(term):
            return java_literal(term)
        body = "\\s+".join(java_literal(w) for w in term.split())
        word = lambda ch: ch.isalnum() or ch == "_"
        return ("(?<!\\w)" if word(term[0]) else "") + body + ("(?!\\w)" if word(term[-1]) else "")

    terms = sorted(display_terms(query), key=len, reverse=True)
    return "(?U)(?iu)(?:" + "|".join(map(one, terms)) + ")" if terms else None


def _cut(content: Column, pattern: str) -> tuple[Column, Column]:
    """The matches, and the stretches between them (one more)."""
    return F.regexp_extract_all(content, F.lit(f"({pattern})"), F.lit(1)), F.split(content, pattern, -1)


def kwic(content: Column, query: str, width: int = KWIC_WIDTH, most: int = KWIC_MOST) -> Column:
    """Array of (left, match, right), at most `most`; empty where the display terms do not occur, though the row may be a hit."""
    pattern = display_pattern(query)
    if pattern is None:
        return F.array().cast("array<struct<left:string,match:string,right:string>>")
    hits, gaps = _cut(content, pattern)

    def context(hit: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(F.arrays_zip(gaps.alias("g"), hits.alias("h")), 1, i), F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["h"])) + F.length(F.get(gaps, i))
        left = F.substring(content, F.greatest(before - width, F.lit(0)) + 1, F.least(before, F.lit(width)))
        return F.struct(left.alias("left"), hit.alias("match"), F.substring(content, before + F.length(hit) + 1, F.lit(width)).alias("right"))

    return F.transform(F.slice(hits, 1, most), context)


def highlight_parts(content: Column, query: str) -> Column:
    """The text in parts (text, is_match), in order and without empty ones; no parts without a term."""
    pattern = display_pattern(query)
    if pattern is None:
        return F.array().cast("array<struct<text:string,is_match:boolean>>")
    hits, gaps = _cut(content, pattern)
    both = F.transform(gaps, lambda g, i: F.array(F.struct(g.alias("text"), F.lit(False).alias("is_match")), F.struct(F.coalesce(F.get(hits, i), F.lit("")).alias("text"), F.lit(True).alias("is_match"))))
    return F.filter(F.flatten(both), lambda p: F.length(p["text"]) > 0)


def locator(page: Column, chapter: Column, seq: Column) -> Column:
    """p.N, else the chapter, else #N; page 0 and empty chapters count as absent."""
    return F.coalesce(F.when(page != 0, F.concat(F.lit("p."), page.cast("string"))), F.when(chapter != "", chapter), F.concat(F.lit("#"), seq.cast("string")))


def chapter_key(edition_id: Column, chapter: Column) -> Column:
    return F.substring(F.sha2(F.concat(edition_id.cast("string"), F.char(F.lit(0)), F.coalesce(chapter, F.lit(""))), 256), 1, 16)


def highlight_ids(c: Column, most: int = HIGHLIGHTS_MOST) -> Column:
    """Ids of a comma-separated list: ASCII digits only, above zero, each once in order, at most `most`."""
    good = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,18}$"))
    return F.slice(F.array_distinct(F.filter(F.transform(good, lambda x: x.cast("long")), lambda n: n > 0)), 1, most)


def name_list(c: Column) -> Column:
    """A list from JSON array text or names between separators; empty or null is the empty list."""
    t = F.trim(F.coalesce(c, F.lit("")))
    parsed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    return F.coalesce(parsed, F.filter(F.transform(F.split(t, "[、,，/;；]\\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 0))


def json_list(c: Column) -> Column:
    """A stored JSON array; anything else is the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def language_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), c), c)


WEB_ADDRESS = "(?i)^(?:https?://)?(?:www\\.)?(?:[a-z0-9-]+\\.)+[a-z]{2,}(?:[/#?]\\S*)?$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def readable(c: Column) -> Column:
    """Text with a letter or digit that is not a web address alone."""
    t = stripped(F.coalesce(c, F.lit("")))
    return t.rlike("[\\p{L}\\p{N}]") & ~t.rlike(WEB_ADDRESS)


# Titles that tell what a chapter is.
NUMERALS = "0-9一二三四五六七八九十百千零〇两"
FRONT = ["cover", "title page", "copyright", "contents", "table of contents", "epigraph", "前言", "序言", "目次", "目录", "著作権", "奥付"]
FRONT_STARTS = ["also by ", "continued", "preface", "foreword"]
BACK = ["afterword", "acknowledgments", "acknowledgements", "后记", "後書き", "あとがき", "致谢", "謝辞"]
BACK_STARTS = ["a note about the author", "about the author", "what’s next", "what's next"]


def title_kind(chapter: Column) -> Column:
    """chapter, part, frontmatter, backmatter or other, by the title alone."""
    t = F.trim(F.regexp_replace(F.coalesce(chapter, F.lit("")), "(?U)\\s+", " "))
    low = F.lower(t)
    starts = lambda names: F.coalesce(*[F.when(low.startswith(n), F.lit(True)) for n in names], F.lit(False))
    kinds = [
        ("chapter", t.rlike(f"(?i)^(?:chapter\\s+[0-9ivxlcdm]+\\b|第\\s*[{NUMERALS}]+\\s*[章話话回節节])")),
        ("part", t.rlike(f"(?i)^(?:part\\s+[0-9ivxlcdm]+\\b|第\\s*[{NUMERALS}]+\\s*部)")),
        ("frontmatter", low.isin(FRONT) | starts(FRONT_STARTS)),
        ("backmatter", low.isin(BACK) | starts(BACK_STARTS)),
    ]
    out = F.lit("other")
    for kind, test in reversed(kinds):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out
