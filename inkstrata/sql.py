"""The engine's surface in SQL: scalar functions for single texts, and a table function that scans one text with recipes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import LEXICAL_REGEX
from .functions import vocabulary as V
from .operators.rules import Recipe, ascii_text, builtin, phrase_regex, word_regex
from .plans.scoring import band_sql

MATCH = T.StructType([T.StructField(n, t) for n, t in (("recipe", T.StringType()), ("kind", T.StringType()), ("matched", T.StringType()), ("line", T.IntegerType()), ("replacement", T.StringType()))])


def register(spark: SparkSession, recipes: list[Recipe] | None = None) -> None:
    """Makes the functions known to `spark.sql`.

    ink_lexical_terms(text), ink_prompt_markers(text) and ink_grade(score) are SQL expressions, so plans see through them;
    ink_recipe_matches(text) is a table function for lateral joins. A null text has no terms, markers or matches.
    """
    quoted = LEXICAL_REGEX.replace("\\", "\\\\").replace("'", "\\'")
    markers = " + ".join(f"CAST(contains(t, '{m.replace(chr(39), chr(92) + chr(39)).replace(chr(10), chr(92) + 'n')}') AS INT)" for m in V.PROMPT)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ink_lexical_terms(text STRING) RETURNS INT RETURN size(regexp_extract_all({lower}, '{quoted}', 0))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ink_prompt_markers(text STRING) RETURNS INT RETURN {markers.replace('(t,', '(' + lower + ',')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ink_grade(score DOUBLE) RETURNS STRING RETURN {band_sql('score')}")
    own = builtin() if recipes is None else recipes

    @F.udtf(returnType=MATCH)
    class RecipeMatches:
        def __init__(self):
            import re

            self.tests = []
            for r in own:
                for kind, make, fold in (("word", word_regex, str.lower), ("phrase", phrase_regex, ascii_text)):
                    if patterns := r.of(kind):
                        self.tests.append((r.name, kind, re.compile(make(patterns)), fold, {fold(p.pattern): p.replacement for p in reversed(patterns)}))

        def eval(self, text: str):
            for no, line in enumerate((text or "").splitlines(), 1):
                for name, kind, test, fold, table in self.tests:
                    for m in test.finditer(fold(line)):
                        yield name, kind, m[0], no, table.get(m[0])

    spark.udtf.register("ink_recipe_matches", RecipeMatches)
