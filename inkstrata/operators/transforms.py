"""Text transforms: comment thinning, recipe replacement, normalising, README cleanup. Nothing is rewritten in place.

What becomes of a line depends on its neighbours only, so every transform filters an array and compares neighbours in it:
linear in the lines of a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.matching import flagged
from ..functions.text import any_of, any_regex, ascii_lower, comment_body, first_words, is_comment, let, lines, once, starts_with_any, trim
from .rules import Recipe, ascii_text, builtin, phrase_regex, word_regex

C = F.col


def joined(kept: Column, content: Column) -> Column:
    return F.concat(F.array_join(kept, "\n"), F.when(F.endswith(content, F.lit("\n")), F.lit("\n")).otherwise(F.lit("")))


def thin_comments(files: DataFrame, column: str = "content") -> DataFrame:
    """Drops comments that narrate or repeat the beginning of the last kept one; adds `thinned` and `removed_comments`.

    A null text stays null.
    """

    def line(raw: Column) -> Column:
        return let(trim(raw), lambda t: let(F.when(is_comment(t), comment_body(t)), lambda body: told(raw, body)))

    def told(raw: Column, body: Column) -> Column:
        own, low = body.isNotNull(), ascii_lower(body)
        safe = any_of(low, V.PRESERVE)
        prefix = F.when(own, first_words(body, 3)).otherwise(F.lit(""))
        return F.struct(raw.alias("raw"), prefix.alias("prefix"), (own & ~safe).alias("may"), (own & ~safe & (any_of(low, V.TUTORIAL) | starts_with_any(low, V.TUTORIAL_STARTS))).alias("narrates"))

    f = once(files, _all=F.transform(lines(C(column)), line))
    # Of what doesn't narrate, a comment goes that begins like the line before: that one, or the one it repeats, stays.
    f = once(f, _some=F.filter("_all", lambda r: ~r["narrates"]))
    repeats = lambda r, i: r["may"] & (r["prefix"] != "") & F.coalesce(r["prefix"] == F.get("_some", i - 1)["prefix"], F.lit(False))
    f = once(f, _kept=F.transform(F.filter("_some", lambda r, i: ~repeats(r, i)), lambda r: r["raw"]))
    return once(f, thinned=F.when(C(column).isNotNull(), joined(C("_kept"), C(column))), removed_comments=F.size("_all") - F.size("_kept")).drop("_all", "_some", "_kept")


def normalise(text: Column) -> Column:
    """Runs of spaces to one, no space before punctuation, no space at line ends; the last line end goes."""
    clean = F.transform(lines(text), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, " {2,}", " "), r"\s+([,.;:!?])", "$1"), r"(?U)\s+$", ""))
    return F.array_join(clean, "\n")


def swapped(f: DataFrame, column: str, regex: str, may: str, table: dict[str, str], fold) -> DataFrame:
    """Replaces every match of the expression that the table names, and adds the number to `_n`.

    Only lines that `may`, for RE2, matches are read with the expression, unless something to be replaced holds a line end.
    """
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    f = once(f, _rows=F.array(column) if any("\n" in x for x in table) else F.split(column, "\n", -1)).withColumn("_may", flagged(may, "_rows"))

    def joined_again(found: Column) -> Column:
        def of(new: Column) -> Column:
            parts = F.transform(found["between"], lambda x, i: F.concat(x, F.coalesce(F.get(new, i), F.get(found["matches"], i), F.lit(""))))
            return F.struct(F.array_join(parts, "").alias("text"), F.size(F.filter(new, lambda x: x.isNotNull())).alias("n"))

        return let(F.transform(found["matches"], lambda m: F.element_at(names, fold(m))), of)

    row = lambda x: let(F.struct(F.regexp_extract_all(x, F.lit(regex), F.lit(0)).alias("matches"), F.split(x, regex, -1).alias("between")), joined_again)
    f = once(f, _done=F.when(F.exists("_may", lambda x: x), F.transform("_rows", lambda x, i: F.when(F.get("_may", i), row(x)).otherwise(F.struct(x.alias("text"), F.lit(0).alias("n"))))))
    there = C("_done").isNotNull()
    text = F.when(there, F.array_join(F.transform("_done", lambda r: r["text"]), "\n")).otherwise(C(column))
    n = C("_n") + F.when(there, F.aggregate("_done", F.lit(0), lambda a, r: a + r["n"])).otherwise(0)
    return once(f, _text=text, _more=n).drop("_rows", "_may", "_done", "_n", column).withColumnsRenamed({"_text": column, "_more": "_n"})


def replace_recipes(files: DataFrame, recipes: list[Recipe] | None = None, column: str = "content") -> DataFrame:
    """Adds `replaced` and `replacements`: words of all recipes in one pass, then phrases, then automatic fixes.

    Texts in which something was replaced are normalised. A null text stays null, with no replacement.
    """
    recipes = builtin() if recipes is None else recipes
    words = [p for r in recipes for p in r.of("word") if p.replacement is not None]
    phrases = [p for r in recipes for p in r.of("phrase") if p.replacement is not None]
    f = files.withColumn("_t", C(column)).withColumn("_n", F.lit(0))
    if words:
        f = swapped(f, "_t", "(?iu)" + word_regex(words), any_regex(p.pattern.lower() for p in words) + r"|[\x{130}\x{131}]", {p.pattern.lower(): p.replacement for p in reversed(words)}, F.lower)
    if phrases:
        f = swapped(f, "_t", "(?i)" + phrase_regex(phrases), phrase_regex(phrases), {ascii_text(p.pattern): p.replacement for p in reversed(phrases)}, ascii_lower)
    for p in (p for r in recipes for p in r.of("regex") if p.fix is not None and not p.applies_to and not p.excludes):
        regex = "(?m)(?U)" + p.pattern
        f = once(f, _fixed=F.regexp_replace("_t", regex, p.fix), _more=C("_n") + F.coalesce(F.regexp_count("_t", F.lit(regex)), F.lit(0))).drop("_t", "_n").withColumnsRenamed({"_fixed": "_t", "_more": "_n"})
    return once(f, replaced=F.when(C("_n") > 0, normalise(C("_t"))).otherwise(C(column)), replacements=C("_n")).drop("_t", "_n")


def clean_readme(files: DataFrame, column: str = "content") -> DataFrame:
    """Drops template lines and headings of empty template sections, and folds blank lines; adds `cleaned` and `removed_lines`."""

    def line(x: Column, i: Column) -> Column:
        t = trim(x)
        heading, phrase = F.startswith(t, F.lit("#")), any_of(ascii_lower(x), V.README_PHRASES)
        title = ascii_lower(trim(F.regexp_replace(t, "^#+", "")))
        return F.struct(i.alias("i"), x.alias("raw"), (t == "").alias("blank"), heading.alias("heading"), phrase.alias("phrase"), (heading & title.isin(*V.README_DROPPABLE)).alias("template"))

    f = once(files, _all=F.transform(lines(C(column)), line))
    # A section is empty if the next line that is a heading or holds text is a heading, or there is none.
    f = once(f, _held=F.filter("_all", lambda r: r["heading"] | (~r["phrase"] & ~r["blank"])))
    empty = F.filter(F.transform("_held", lambda r, i: F.when(r["template"] & F.coalesce(F.get("_held", i + 1)["heading"], F.lit(True)), r["i"])), lambda i: i.isNotNull())
    f = once(f, _empty=empty)
    f = once(f, _some=F.filter("_all", lambda r: ~r["phrase"] & ~(r["template"] & F.array_contains("_empty", r["i"]))))
    f = once(f, _kept=F.transform(F.filter("_some", lambda r, i: ~(r["blank"] & F.coalesce(F.get("_some", i - 1)["blank"], F.lit(False)))), lambda r: r["raw"]))
    cleaned = F.when(C(column).isNull(), F.lit(None).cast("string")).when(F.size("_all") == 0, F.lit("")).otherwise(joined(C("_kept"), C(column)))
    return once(f, cleaned=cleaned, removed_lines=F.size("_all") - F.size("_some")).drop("_all", "_held", "_empty", "_some", "_kept")


def transform(files: DataFrame, recipes: list[Recipe] | None = None, detectors: tuple[str, ...] = (), mode: str = "compose") -> DataFrame:
    """All or the named transforms, each on the one before (`compose`) or on the original (`independent`)."""
    wanted = {"recipe" if d == "lexical" else d for d in detectors} or {"comments", "recipe", "readme"}
    f = files.withColumn("transformed", C("content")).withColumn("n_replaced", F.lit(0)).withColumn("n_removed", F.lit(0))
    source = "transformed" if mode == "compose" else "content"
    if "comments" in wanted:
        f = thin_comments(f, source).withColumn("transformed", C("thinned")).withColumn("n_removed", C("n_removed") + C("removed_comments")).drop("thinned", "removed_comments")
    if "recipe" in wanted:
        f = replace_recipes(f, recipes, source).withColumn("transformed", C("replaced")).withColumn("n_replaced", C("replacements")).drop("replaced", "replacements")
    if "readme" in wanted:
        md = C("ext") == "md"
        f = clean_readme(f.withColumn("_md", F.when(md, C(source))), "_md").drop("_md").withColumn("transformed", F.when(md, C("cleaned")).otherwise(C("transformed"))).withColumn("n_removed", C("n_removed") + F.when(md, C("removed_lines")).otherwise(0)).drop("cleaned", "removed_lines")
    return f.withColumn("changed", ~C("transformed").eqNullSafe(C("content")))


def transform_summary(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if("changed").alias("files_changed"), F.coalesce(F.sum("n_replaced"), F.lit(0)).alias("replacements"), F.coalesce(F.sum("n_removed"), F.lit(0)).alias("removed"))
