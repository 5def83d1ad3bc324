"""Text kernel as Column expressions: line splitting, ASCII case, trimming, marker hits, variation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: These hold another term that ends earlier, so they can never match.
DEAD_TERMS = tuple(t for t in V.LEXICAL if any(o != t and o in t and t.index(o) + len(o) < len(t) for o in V.LEXICAL))
LEXICAL_PATTERN = "|".join(t for t in V.LEXICAL if t not in DEAD_TERMS)


def any_regex(terms: Iterable[str]) -> str:
    """A regular expression for any of the terms, the longest first, that reads their common beginnings once."""
    tree: dict = {}
    for term in terms:
        at = tree
        for c in term:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + "?" * ("" in node)

    return written(tree)


LEXICAL_REGEX = any_regex(t for t in V.LEXICAL if t not in DEAD_TERMS)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once for each row: what a generator gives is not written into later expressions."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def trim(x: Column) -> Column:
    """Without spaces at both ends; a text whose first and last characters are none is taken as it is."""
    return F.when(F.regexp_like(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))), F.lit(r"(?U)\s")), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)


def lines(content: Column) -> Column:
    r"""Lines at \n or \r\n, without an empty one at the end."""
    text = F.coalesce(content, F.lit(""))
    cut = lambda n: F.left(text, F.length(text) - n)
    whole = F.when(F.endswith(text, F.lit("\r\n")), cut(2)).when(F.endswith(text, F.lit("\n")), cut(1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\r?\n"))


def hits(x: Column, markers: Iterable[str]) -> Column:
    """Number of different markers that x contains."""
    return reduce(lambda a, b: a + b, (F.contains(x, F.lit(m)).cast("int") for m in markers))


def any_of(x: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in markers))


def starts_with_any(x: Column, starts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(x, F.lit(s)) for s in starts))


def occurrences(x: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def is_comment(trimmed: Column) -> Column:
    hash_line = F.startswith(trimmed, F.lit("#")) & ~F.startswith(trimmed, F.lit("#[")) & ~F.startswith(trimmed, F.lit("#!["))
    return starts_with_any(trimmed, ("//", "/*", "*")) | hash_line


def comment_body(trimmed: Column) -> Column:
    return trim(F.regexp_replace(trimmed, r"^/*\**#*", ""))


def first_words(x: Column, n: int) -> Column:
    """The first n words of a trimmed text, '' if it has none."""
    return F.array_join(F.slice(F.split(ascii_lower(x), r"(?U)\s+"), 1, n), " ")


def mode_count(values: Column) -> Column:
    """How often the most frequent element of an array of texts occurs; 0 if it is empty. Equal ones stand together when sorted."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.coalesce(F.aggregate(F.array_sort(values), start, step, lambda a: a["best"]), F.lit(0))


def language(ext: Column) -> Column:
    out = F.lit("unknown")
    for name, extensions in V.LANGUAGES.items():
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)
