"""Text predicates and counts as Columns; everything stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what a heading, sentence, exception, reference or table row is.
MARKDOWN_HEADING = r"(?U)^(#{1,6})\s+(\S.*?)\s*$"
SECTION_HEADING = r"(?U)^Section\s+(\d+)\s+[–—-]\s+(\S.*?)\s*$"
DOTTED_HEADING = r"(?U)^(\d+(?:\.\d+)*)\.\s+(\S.*?)\s*$"
BARE_HEADING = r"(?U)^(\d+\.\d+(?:\.\d+)*)\s+(\S.*?)\s*$"
SENTENCE_BREAK = r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"“])"""
BLOCK_BREAK = r"(?U)\n\s*\n"
#: A sentence with the white space behind it: up to a blank line, a sentence break that no blank line is in, or the end.
#: Stops are looked at only where a line or a run of closing marks ends.
_SENTENCE_END = r"""(?!\s*\n\s*\n)\s+(?=[A-Z0-9"“])"""
SENTENCE = rf"""(?sU)(?:[^\n.!?]++|[.!?]++(?!{_SENTENCE_END})|\n(?!\s*\n))*+(?:\n\s*\n|[.!?]++{_SENTENCE_END}|\z)"""
EXCEPTION = r"(?iU)(^\s*exception\b|\b(except|unless)\b|\bexception applies\b)"
REFERENCE = r"(?iU)\b(refer to|see section|see the)\b[^.\n]{0,160}"
TABLE_ROW = r"(?U)^\s*\|.+\|\s*$"
TABLE_RULE = r"(?U)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
WORD = r"(?U)\S+"
WORD_TOKENIZER = "word-v1"
TITLE_WORDS, TITLE_CHARS, TITLE_STOPS = 12, 80, ".:;"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Tokens of the word tokenizer: runs of non-space, Unicode white space included."""
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_title(title: Column) -> Column:
    """1 to 12 words, at most 80 characters, an upper-case start, no closing ``.``, ``:`` or ``;``."""
    return (
        word_count(title).between(1, TITLE_WORDS)
        & (F.length(title) <= TITLE_CHARS)
        & ~F.right(title, F.lit(1)).isin(*TITLE_STOPS)
        & title.rlike(r"^\p{Lu}")
    )


def heading(line: Column) -> Column:
    """The line's formatted heading, or null: Markdown, ``Section N –`` or numbered, each with a title."""

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    def titled(pattern: str, shown: Column) -> Column:
        return F.when(line.rlike(pattern) & is_title(group(pattern, 2)), shown)

    found = F.coalesce(
        titled(MARKDOWN_HEADING, group(MARKDOWN_HEADING, 2)),
        titled(SECTION_HEADING, F.concat_ws(" ", F.lit("Section"), group(SECTION_HEADING, 1), group(SECTION_HEADING, 2))),
        # A line of the dotted form is never tried as the bare one: their titles would be the same.
        *[titled(p, F.concat_ws(" ", group(p, 1), group(p, 2))) for p in (DOTTED_HEADING, BARE_HEADING)])
    return F.when(F.left(line, F.lit(1)).rlike(r"(?U)[#S\d]"), found)  # most lines are none by their first character


def sentences(text: Column) -> Column:
    """Sentences of a text, ends trimmed, blanks dropped."""
    parts = F.transform(F.split(text, SENTENCE_BREAK), lambda s: F.regexp_replace(s, r"(?U)\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def _has(text: Column, *parts: str) -> Column:
    """Whether one of some lower-case parts occurs in any case: spares most texts a costlier search."""
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]))


def is_exception(text: Column) -> Column:
    return _has(text, "excep", "unle") & text.rlike(EXCEPTION)


def references(text: Column) -> Column:
    """Distinct reference phrases in the order they first appear."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    return F.when(text.isNull() | _has(text, "refer to", "ee section", "ee the", "ee ſection"), found).otherwise(F.array().cast("array<string>"))


def is_table_row(line: Column) -> Column:
    return F.contains(line, F.lit("|")) & line.rlike(TABLE_ROW)


def is_table_rule(line: Column) -> Column:
    return F.contains(line, F.lit("---")) & line.rlike(TABLE_RULE)


def within_words(text: Column, least: int = 500, most: int = 800) -> Column:
    """The gate for written policies: a number of words within bounds."""
    return F.coalesce(word_count(text).between(least, most), F.lit(False))


def has_table(text: Column) -> Column:
    return F.contains(text, F.lit("---")) & F.exists(F.split(text, "\n"), is_table_rule)


#: What (?U)\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_end(text: Column) -> Column:
    """Without the white space, Unicode's included, at its end."""
    return F.rtrim(text, F.lit(WHITE))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def embedding_input(title: Column, heading_path: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), title, F.lit(" / "), heading_path, F.lit(" | text: "), text)


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each starting ``size - overlap`` after the last; the tail once."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the window size")
    step = size - overlap

    def cut(w: Column) -> Column:
        last = F.greatest(F.size(w) - F.lit(overlap) - 1, F.lit(0))
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), last - last % step, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))

    return let(words(text), cut)


def sums_before(sizes: Column) -> Column:
    """For each of an array's ints the sum of those before it.

    A fold copies all that it carries at every step, so a fold that carries its own output costs the square of the
    array's length.  Here blocks of about the root of that length are summed each, and then their totals.
    """

    def folded(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))

    def blocks(x: Column, width: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), width)
        return F.transform(starts, lambda s: folded(F.slice(x, s, width)))

    def joined(b: Column) -> Column:
        at = folded(F.transform(b, lambda y: y["at"]))["out"]
        return let(at, lambda base: F.flatten(F.transform(b, lambda y, i: F.transform(y["out"], lambda n: n + F.get(base, i)))))

    width = lambda x: F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int")
    return let(sizes, lambda x: F.when(F.size(x) > 0, let(width(x), lambda w: let(blocks(x, w), joined))).otherwise(F.array().cast("array<int>")))


def normalize_spaces(text: Column) -> Column:
    """The text with every white-space run as one space, and where each of its words began in the original.

    Struct (normalized, offsets): offsets holds (normalized start, original start) for each run of
    non-space, so any span of the normalized copy maps back; the original is kept by the caller.
    """
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0)), F.length)

    def places(runs: Column, word: Column) -> Column:
        def placed(to: Column, from_: Column) -> Column:
            return F.transform(word, lambda n, i: F.struct(F.get(to, i).alias("normalized"), (F.get(from_, i) + F.get(runs, i) - n).alias("original")))

        return let(sums_before(F.transform(word, lambda n: n + 1)), lambda to: let(sums_before(runs), lambda from_: placed(to, from_)))

    offsets = let(runs, lambda r: let(F.transform(words(text), F.length), lambda w: places(r, w)))
    return F.struct(F.array_join(words(text), " ").alias("normalized"), offsets.alias("offsets"))
