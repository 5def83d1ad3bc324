"""Baselines of a corpus's own style."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import is_comment, occurrences
from .files import comments, prepared

C = F.col


def baseline(files: DataFrame) -> DataFrame:
    """Means over files of at least eight lines that are not empty; terms are counted each for itself, overlaps too."""
    p = comments(prepared(files).where("lang <> 'unknown'")).where("non_empty >= 8")
    low = F.lower("content")
    terms = reduce(lambda a, b: a + b, (occurrences(low, t) for t in V.LEXICAL))
    doc = F.size(F.filter("trimmed", lambda x: is_comment(x) & (F.startswith(x, F.lit("///")) | F.startswith(x, F.lit("/**")) | F.startswith(x, F.lit("//!")))))
    m = p.select("density", (doc / C("non_empty")).alias("doc_ratio"), terms.alias("terms"), "non_empty")
    out = m.agg(F.count("*").alias("files"), F.avg("density").alias("comment_density"), F.avg("doc_ratio").alias("doc_ratio"), (100 * F.sum("terms") / F.sum("non_empty")).alias("terms_per_100_lines"))
    return out.withColumn("threshold", F.least(F.lit(0.80), F.greatest(F.lit(0.20), 1.5 * C("comment_density"))))


def save(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def load(spark, path: str) -> DataFrame | None:
    """What was saved, or None where nothing was."""
    try:
        return spark.read.json(path)
    except AnalysisException:
        return None


def comment_threshold(found: DataFrame | None, default: float = 0.45) -> float:
    """The threshold that a scan takes from a baseline, or its own without one."""
    row = None if found is None else found.select("threshold").first()
    return default if row is None or row.threshold is None else row.threshold
