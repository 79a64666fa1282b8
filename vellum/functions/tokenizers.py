"""Token counters that chunking takes as parameters.

A counter is any Column function of a string that stays in the JVM.  Whether its counts add up over texts
that white space parts is stated, not assumed: where they don't, every candidate text is counted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T


class Tokenizer(NamedTuple):
    """``name`` goes into the fingerprint; ``count`` gives an int that never falls as a text grows."""

    name: str
    count: Callable[[Column], Column]
    additive: bool = False

    def slices(self, text: Column, most: Column | int) -> Column:
        """Spans (start, end) of a text, in order, of at most ``most`` tokens each; only white space may lie between them."""
        most = F.lit(most) if isinstance(most, int) else most
        return _word_slices(text, most) if self is WORDS else _searched(text, most, self.count)


_SPANS = "array<struct<start:int,end:int>>"


def _word_slices(text: Column, most: Column) -> Column:
    """So many words at a time, with the space behind them (the first also with that before it)."""

    def parts(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / most).cast("int") - 1), lambda i: F.length(F.array_join(F.slice(w, i * most + 1, most), "")))

    def add(a: Column, n: Column) -> Column:
        return F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + n).alias("end")))).alias("out"))

    words = F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+\s*"), F.lit(0))
    sizes = T.let(words, lambda w: F.when(F.size(w) > 0, parts(w)).otherwise(F.array().cast("array<int>")))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")), add, lambda a: a["out"])


def _searched(text: Column, most: Column, count: Callable[[Column], Column]) -> Column:
    """The longest prefix within the limit, found by halving, and so on with the rest.

    A prefix that ends inside a word goes back to the last space before it, if a token is left.
    """

    def longest(rest: Column) -> Column:
        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["least"] + a["upto"] + 1) / 2).cast("int")
            fits = count(F.substring(rest, F.lit(1), middle)) <= most
            return F.struct(F.when(fits, middle).otherwise(a["least"]).alias("least"), F.when(fits, a["upto"]).otherwise(middle - 1).alias("upto"))

        start = F.struct(F.lit(0).alias("least"), F.length(rest).alias("upto"))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.length(rest) + 1.0)).cast("int")), start, halve, lambda a: a["least"])

    def end(rest: Column) -> Column:
        def back(most_: Column, whole: Column) -> Column:
            space = F.length(whole) - F.locate(" ", F.reverse(whole))  # the characters before the last space
            inside = (most_ < F.length(rest)) & ~F.right(whole, F.lit(1)).rlike(r"(?U)\s") & F.contains(whole, F.lit(" "))
            kept = F.when(inside & (space > 0) & (count(F.substring(rest, F.lit(1), space)) >= 1), space).otherwise(most_)
            return F.when(kept > 0, kept).otherwise(F.raise_error(F.lit("one character exceeds the token limit")).cast("int"))

        return T.let(longest(rest), lambda n: T.let(F.substring(rest, F.lit(1), n), lambda whole: back(n, whole)))

    def step(a: Column, _: Column) -> Column:
        def cut(k: Column) -> Column:
            behind = F.substring(a["rest"], k + 1, F.length(a["rest"]))
            after = F.regexp_replace(behind, r"^(?U)\s+", "")
            return F.struct((a["at"] + F.length(a["rest"]) - F.length(after)).alias("at"), after.alias("rest"),
                            F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + k).alias("end")))).alias("out"))

        return F.when(a["rest"] == "", a).otherwise(T.let(end(a["rest"]), cut))

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), count(text)), start, step, lambda a: a["out"])


WORDS = Tokenizer(T.WORD_TOKENIZER, T.word_count, True)
#: Four characters a token, a part of four counted as a whole: its counts do not add up.
QUADS = Tokenizer("chars-4", lambda t: F.ceil(F.length(t) / 4).cast("int"))
