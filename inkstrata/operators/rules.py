"""Per-line rules: security patterns and recipes, with the cluster boost over buckets of lines.

Security rules, words and phrases are tried on all lines at once, and words and phrases are read where that succeeds.
"""

from __future__ import annotations

import re
import tomllib
import warnings
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import recipes as R
from ..functions import vocabulary as V
from ..functions.matching import LineTest, matching
from ..functions.text import any_regex, ascii_lower
from ..sources.corpus import glob_regex
from .files import FINDING, FLAG, emit

C = F.col


def _rows(test, found) -> Column:
    """What `found` makes of each line that passes and its number."""
    return F.filter(F.transform("lines", lambda x, i: F.when(test(x), found(i + 1))), lambda x: x.isNotNull())


def no_flags() -> Column:
    return F.array().cast(f"array<{FLAG}>")


def _flag(detector: str, id_, category: str, severity, confidence: float, line: Column, ord_: Column, recipe=None, kind=None, key=None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        F.lit(detector).alias("detector"), text(id_).alias("id"), F.lit(category).alias("category"), text(severity).alias("severity"), F.lit(float(confidence)).alias("confidence"), line.cast("int").alias("line_start"), line.cast("int").alias("line_end"),
        ord_.cast("long").alias("ord"), text(recipe).alias("recipe"), text(kind).alias("kind"), text(key).alias("key"),
    ).cast(FLAG)


def security_flags() -> Column:
    """An array with a finding for each rule and line that it matches."""
    keep = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, V.SKIPPED_SECURITY)))
    found = lambda k, id_, severity, confidence: lambda line: _flag("security", id_, "security", severity, confidence, line, 8 * 10**12 + line.cast("long") * 100 + k)
    rules = [F.transform(C("security_at")[id_], found(k, id_, severity, confidence)) for k, (id_, severity, confidence, *_) in enumerate(V.SECURITY)]
    return F.when(keep, F.flatten(F.array(*rules))).otherwise(no_flags())


def security_findings(p: DataFrame) -> DataFrame:
    """One row for each rule and line that it matches."""
    return emit(p.where(C("ext").isin(*V.SECURITY_EXTENSIONS)), more=security_flags()).select(*FINDING)


@dataclass
class Pattern:
    kind: str  # word, phrase, regex, contextual
    name: str
    pattern: str
    severity: str
    replacement: str | None = None
    case_sensitive: bool = False
    whole_word: bool = True
    is_regex: bool = False
    applies_to: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    fix: str | None = None


@dataclass
class Recipe:
    name: str
    category: str
    patterns: list[Pattern] = field(default_factory=list)
    threshold: int = 3
    bucket: int = 10
    boost: str | None = None
    confidence: float = 0.7
    source: str = "builtin"
    location: str = ""
    enabled: bool = True

    def __post_init__(self):
        if not 0 <= self.confidence <= 1:
            raise ValueError(f"{self.name}: base_confidence {self.confidence} is not in [0, 1]")

    def of(self, kind: str) -> list[Pattern]:
        return [p for p in self.patterns if p.kind == kind]


def builtin() -> list[Recipe]:
    words = [Pattern("word", w, w, "low", r) for w, r in R.WORDS.items()]
    phrases = [Pattern("phrase", p.replace(" ", "-"), p, "medium", r) for p, r in R.PHRASES.items()]
    turns = [Pattern("phrase", p.replace(" ", "-"), p, s, r) for p, (s, r) in R.TURNS.items()]
    readme = [Pattern("contextual", n, p, s, is_regex=True, applies_to=("README.md", "README*.md", "readme.md")) for n, (s, p) in R.README.items()]
    comments = [Pattern("regex", n, p, s) for n, (s, p) in R.COMMENTS.items()]
    made = (("slop-vocabulary", "lexical", words + phrases), ("phrase-patterns", "lexical", turns + readme), ("comment-patterns", "comment", comments))
    return [Recipe(n, c, ps, *R.SCORING[n]) for n, c, ps in made]


def load(path: str | Path, source: str = "local") -> Recipe:
    """A recipe from TOML; items may be strings or tables."""
    data = tomllib.loads(Path(path).read_text())
    head, groups, scoring = data["recipe"], data.get("patterns", {}), data.get("scoring", {})
    default = head.get("default_severity", "medium").lower()
    patterns = []
    for kind, key in (("word", "word"), ("phrase", "match")):
        group = groups.get(kind + "s", {})
        for item in group.get("items", []) if group.get("enabled", True) else []:
            item = {key: item} if isinstance(item, str) else item
            severity = item.get("severity", group.get("severity", default)).lower()
            patterns.append(Pattern(kind, item[key].replace(" ", "-") if kind == "phrase" else item[key], item[key], severity, item.get("replacement", item.get("suggestion")), item.get("case_sensitive", group.get("case_sensitive", False)), item.get("whole_word", group.get("whole_word", True))))
    for kind in ("regex", "contextual"):
        for item in groups.get(kind, []):
            re.compile(item["pattern"])
            patterns.append(Pattern(kind, item["name"], item["pattern"], item.get("severity", default).lower(), item.get("suggestion"), is_regex=kind == "regex" or item.get("is_regex", False), applies_to=tuple(item.get("applies_to", ())), excludes=tuple(item.get("excludes", ())), fix=item.get("fix_pattern") if item.get("auto_fixable") else None))
    boost = scoring.get("cluster_severity_boost")
    return Recipe(head["name"], head.get("category", "lexical").lower(), patterns, scoring.get("cluster_threshold", 3), scoring.get("cluster_range_lines", 10), boost and boost.lower(), scoring.get("base_confidence", 0.7), source, str(path), head.get("enabled", True))


def discover(*folders: tuple[str, str | Path]) -> list[Recipe]:
    """The built-in recipes, then those of each (source, folder) in order: a user's before a repository's.

    All are kept, also where names repeat. Folders that do not exist hold none; what cannot be read is left out with a
    warning.
    """
    found = builtin()
    for source, folder in folders:
        for path in sorted(Path(folder).glob("*.toml")):
            try:
                found.append(load(path, source))
            except (OSError, ValueError, KeyError, TypeError, AttributeError, re.error) as e:
                warnings.warn(f"recipe {path} left out: {e}", stacklevel=2)
    return found


def select(recipes: list[Recipe], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> list[Recipe]:
    """Exclusion by name goes before inclusion, and that before what recipes say of themselves."""
    return [r for r in recipes if r.name not in exclude and (r.name in include if include else r.enabled)]


def listing(spark, recipes: list[Recipe]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.source, r.location, len(r.patterns)) for r in recipes], "name string, source string, location string, n_patterns int")


def word_regex(patterns: list[Pattern]) -> str:
    """Longest first; boundaries are ASCII word characters only."""
    return rf"(?<![A-Za-z0-9_])(?:{any_regex(p.pattern.lower() for p in patterns)})(?![A-Za-z0-9_])"


def phrase_regex(patterns: list[Pattern]) -> str:
    return any_regex(ascii_text(p.pattern) for p in patterns)


def ascii_text(x: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in x)


def applies(pattern: Pattern) -> Column:
    """Excluding globs win; a glob matches the path or the name; none: every file."""
    match = lambda globs: reduce(lambda a, b: a | b, (F.regexp_like(x, F.lit(glob_regex(g))) for g in globs for x in (C("path"), C("name"))), F.lit(False))
    wanted = match(pattern.applies_to) if pattern.applies_to else F.lit(pattern.kind != "contextual")
    return wanted & ~match(pattern.excludes)


def recipe_tests(recipes: list[Recipe]) -> tuple[LineTest, ...]:
    """Tests of lines that may hold words or phrases of a recipe; they take some more lines, as where words have no ends."""
    out = []
    for order, recipe in enumerate(recipes):
        # Lower case makes an i and a mark of the dotted capital I.
        for kind, text, more in (("word", str.lower, "|\u0130"), ("phrase", ascii_text, "")):
            if patterns := recipe.of(kind):
                out.append(LineTest(f"{kind}{order}", any_regex(text(p.pattern) for p in patterns) + more, True))
    return tuple(out)


def with_matches(p: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Adds the lines that `recipe_flags` needs, in the pass that finds those of other tests."""
    tests = recipe_tests(recipes)
    return p.withColumn("recipe_at", matching(tests)) if tests else p


def recipe_flags(recipes: list[Recipe]) -> Column:
    """An array of the matches of all recipes; ids and severities follow by `named`. Needs `with_matches`."""
    out = []

    def each(at: Column, regex: Column, fold, kind: str, make, place) -> Column:
        def in_line(i: Column) -> Column:
            return F.transform(F.regexp_extract_all(fold(F.get("lines", i - 1)), regex, F.lit(0)), lambda m, j: make(i, place(i, j), kind, m))

        return F.flatten(F.transform(at, in_line))

    for order, recipe in enumerate(recipes):
        place = lambda line, nth=0, order=order: 10**12 * (20 + order) + line.cast("long") * 1000 + nth
        make = lambda line, ord_, kind, key, recipe=recipe: _flag("recipe", None, recipe.category, None, recipe.confidence, line, ord_, recipe.name, kind, key)
        for kind, expression, fold in (("word", word_regex, F.lower), ("phrase", phrase_regex, ascii_lower)):
            if patterns := recipe.of(kind):
                out.append(each(C("recipe_at")[f"{kind}{order}"], F.lit(expression(patterns)), fold, kind, make, place))
        for pattern in recipe.of("regex") + recipe.of("contextual"):
            regex = F.lit("(?U)" + pattern.pattern) if pattern.is_regex or pattern.kind == "regex" else None
            test = (lambda x, regex=regex: F.regexp_like(x, regex)) if regex is not None else (lambda x, pattern=pattern: F.contains(x, F.lit(pattern.pattern)))
            got = _rows(test, lambda line, pattern=pattern, make=make, place=place: make(line, place(line), pattern.kind, F.lit(pattern.name)))
            out.append(F.when(applies(pattern), got).otherwise(no_flags()))
    return F.flatten(F.array(*out)) if out else no_flags()


def named(found: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Fills in what a match stands for, from a table of as many rows as the recipes have patterns."""
    rows = [(r.name, x.kind, x.pattern.lower() if x.kind == "word" else ascii_text(x.pattern) if x.kind == "phrase" else x.name, f"{r.name}:{x.kind}:{x.name}", x.severity, x.replacement) for r in recipes for x in r.patterns]
    meta = found.sparkSession.createDataFrame(list({row[:3]: row for row in reversed(rows)}.values()), "recipe string, kind string, key string, _id string, _severity string, replacement string")
    got = found.drop("suggestion").join(F.broadcast(meta), ["recipe", "kind", "key"], "left").withColumn("suggestion", C("replacement"))
    return got.withColumn("id", F.coalesce("id", "_id")).withColumn("severity", F.coalesce("severity", "_severity")).drop("_id", "_severity")


def recipe_findings(p: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Matches of all recipes: (…FINDING, recipe, kind, matched, replacement); clusters not yet boosted."""
    return named(emit(with_matches(p, recipes), more=recipe_flags(recipes)), recipes).select(*FINDING, "recipe", "kind", C("key").alias("matched"), "replacement")


def boosted(found: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """Severity and confidence of matches in lines that hold a cluster of their recipe's matches."""
    rule = p = F.lit(None).cast("int")
    bucket, boost = p, F.lit(None).cast("string")
    for r in recipes:
        mine = C("recipe") == r.name
        rule, bucket, boost = F.when(mine, r.threshold).otherwise(rule), F.when(mine, r.bucket).otherwise(bucket), F.when(mine, F.lit(r.boost)).otherwise(boost)
    f = found.withColumn("_t", rule).withColumn("_b", F.floor((C("line_start") - 1) / F.nullif(bucket, F.lit(0)))).withColumn("_s", boost)
    f = f.withColumn("_all", F.count("*").over(W.partitionBy("repo", "path", "recipe"))).withColumn("_n", F.count("*").over(W.partitionBy("repo", "path", "recipe", "_b")))
    hot = F.coalesce((C("_all") >= C("_t")) & (C("_n") >= C("_t")) & C("_s").isNotNull() & C("_b").isNotNull(), F.lit(False))
    f = f.withColumn("severity", F.when(hot, C("_s")).otherwise(C("severity"))).withColumn("confidence", F.when(hot, F.least(F.lit(1.0), C("confidence") + 0.15)).otherwise(C("confidence"))).withColumn("boosted", hot)
    return f.drop("_t", "_b", "_s", "_all", "_n")
