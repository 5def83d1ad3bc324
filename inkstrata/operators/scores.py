"""Scores over the findings table: summary, explanation, grade, mixed-content selection, calibration, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..sources.corpus import cut

C = F.col


def by_severity(low: float, medium: float, high: float) -> Column:
    return F.when(C("severity") == "high", F.lit(high)).when(C("severity") == "medium", F.lit(medium)).otherwise(F.lit(low))


WEIGHT, RAW = (0.2, 0.6, 1.0), (0.5, 1.5, 3.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def summary(findings: DataFrame) -> DataFrame:
    """One row: totals by severity and the probability; 0 without findings."""
    mean = F.avg(by_severity(*WEIGHT) * C("confidence"))
    return findings.agg(F.count("*").alias("total"), *(F.count_if(C("severity") == s).alias(s) for s in V.SEVERITIES), F.coalesce(sigmoid(8 * (mean - 0.5)), F.lit(0.0)).alias("ai_probability"))


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"))


def contributions(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"), F.sum(by_severity(*WEIGHT) * C("confidence")).alias("contribution")).orderBy(F.desc("contribution"), "category")


def evidence(findings: DataFrame, n: int | None = 5) -> DataFrame:
    """Findings by contribution; the report shows the first n."""
    out = findings.withColumn("contribution", by_severity(*WEIGHT) * C("confidence")).orderBy(F.desc("contribution"), "repo", "path", "id", "ord")
    return out.limit(n) if n else out


def band(score: Column) -> Column:
    out = F.lit("F")
    for most, name in reversed(V.GRADE_BANDS):
        out = F.when(score <= most, name).otherwise(out)
    return out


def grade_rank(grade: Column) -> Column:
    names = [n for _, n in V.GRADE_BANDS] + ["F"]
    return F.array_position(F.array(*map(F.lit, names)), grade)


def grade_of(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in V.GRADE_OF.items() for x in kv])[category]


def category_grades(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """All nine categories, with those that have no finding at 0."""
    nine = spark.createDataFrame(list(V.GRADE_WEIGHTS.items()), "grade_category string, weight double")
    got = findings.groupBy(grade_of(C("category")).alias("grade_category")).agg(F.count("*").alias("n"), F.sum(by_severity(*RAW) * C("confidence")).alias("raw"))
    out = nine.join(got, "grade_category", "left").fillna(0, ["n", "raw"]).withColumn("score", F.least(F.lit(100.0), C("raw") * 3.33))
    return out.withColumn("grade", band(C("score")))


def overall_grade(spark: SparkSession, findings: DataFrame) -> DataFrame:
    return overall(category_grades(spark, findings))


def overall(g: DataFrame) -> DataFrame:
    """The grade of the whole from those of the categories."""
    some = C("n") > 0
    score = F.coalesce(F.sum(F.when(some, C("score") * C("weight"))) / F.sum(F.when(some, C("weight"))), F.lit(0.0))
    return g.agg(score.alias("score"), F.sum("n").alias("n")).withColumn("grade", band(C("score")))


def meets(grade: DataFrame, least: str) -> DataFrame:
    return grade.withColumn("meets", grade_rank(C("grade")) <= grade_rank(F.lit(least)))


def mixed(findings: DataFrame, lines: int = 80) -> DataFrame:
    """The strongest finding of each category in each segment of a file, the first of equals; those without lines stay."""
    findings = cut(findings)
    rank = F.when(C("severity") == "high", 2).when(C("severity") == "medium", 1).otherwise(0)
    here = findings.where("line_start is not null")
    best = here.groupBy("repo", "path", F.floor((C("line_start") - 1) / lines).alias("segment"), "category").agg(F.max_by(F.struct(*findings.columns), F.struct(rank, "confidence", -C("ord"), "id")).alias("f"))
    return best.select("f.*").unionByName(findings.where("line_start is null"))


def calibrate(findings: DataFrame, baseline_threshold: float | None = None) -> DataFrame:
    s = summary(findings)
    return s.select(F.when((C("high") == 0) & (C("medium") <= 1), "high").otherwise("medium").alias("min_severity"), F.lit(0.45 if baseline_threshold is None else baseline_threshold).alias("comment_threshold"))


def score_breakdown(df: DataFrame, a: str = "a", b: str = "b", c: str = "c") -> DataFrame:
    total = C(a) + C(b) + C(c)
    return df.withColumn("total", total).withColumn("level", F.when(total >= 8, "high").when(total >= 5, "medium").otherwise("low"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Of (predicted, expected): counts, precision, recall and accuracy, 0 where undefined."""
    p, e = C("predicted"), C("expected")
    m = predictions.agg(F.count_if(p & e).alias("tp"), F.count_if(~p & ~e).alias("tn"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return m.select("*", div(C("tp"), C("tp") + C("fp")).alias("precision"), div(C("tp"), C("tp") + C("fn")).alias("recall"), div(C("tp") + C("tn"), C("tp") + C("tn") + C("fp") + C("fn")).alias("accuracy"))


def rollup(findings: DataFrame) -> DataFrame:
    return findings.rollup("repo", "category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    keep = V.SEVERITIES[V.SEVERITIES.index(severity) :]
    return findings.where(C("severity").isin(*keep))


def of_categories(findings: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Findings of the named categories; of all without names."""
    return findings.where(C("category").isin(*categories)) if categories else findings


def confident(findings: DataFrame, least: float = 0.75) -> DataFrame:
    return findings.where(C("confidence") >= least) if least > 0 else findings


def gate(findings: DataFrame, fail_on: str) -> bool:
    """Whether any finding is as severe as fail_on."""
    return not at_least(findings, fail_on).isEmpty()
