"""What users call: scan, grade, transform, learn, calibrate, evaluate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import once
from .operators import files as D
from .operators import learn as L
from .operators import repos as R
from .operators import rules as U
from .operators import scores as S
from .operators import transforms as X
from .sources.corpus import hushed, without_ignored

C = F.col

REPO_DETECTORS = (R.architecture_findings, R.workflow_findings, R.metadata_findings, R.promotion_findings, R.maintenance_findings, R.name_findings)


def file_findings(files: DataFrame, comment_threshold: float = 0.45, recipes: list | None = None, security: bool = True) -> DataFrame:
    """Findings of all file detectors, in one pass over the files, without those on suppressed lines.

    Also on a stream when recipes is an empty list: a recipe's clusters need all matches of a file.
    """
    recipes = U.builtin() if recipes is None else recipes
    p = D.add_all(U.with_matches(D.prepared(without_ignored(files)), recipes))
    more = [*([U.security_flags()] if security else []), *([U.recipe_flags(recipes)] if recipes else [])]
    p = once(p, found=F.concat(F.filter(F.array(*D.all_flags(comment_threshold)), lambda f: f.isNotNull()), *more), hush=hushed(C("lines")))
    rows = p.select("repo", "path", "hush", F.inline("found"), F.lit(None).cast("string").alias("suggestion"))
    rows = rows.withColumn("hush", C("line_start").isNotNull() & F.array_contains("hush", C("line_start")))
    if recipes:
        rows = U.boosted(U.named(rows, recipes), recipes)
    return rows.where("not hush").select(*D.FINDING)


def repo_findings(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Findings of the repository detectors, if given only of the repositories in `repos` (repo): those under version control."""
    if repos is not None:
        files = files.join(repos.select("repo").distinct(), "repo", "left_semi")
    return reduce(DataFrame.unionByName, (detect(files) for detect in REPO_DETECTORS))


def scan(
    files: DataFrame, commits: DataFrame | None = None, min_severity: str = "low", mixed: bool = False, comment_threshold: float = 0.45, recipes: list | None = None, security: bool = True,
    repos: DataFrame | None = None, categories: tuple[str, ...] = (), min_confidence: float = 0.0,
) -> DataFrame:
    """The findings table of files and, if given, commits."""
    found = file_findings(files, comment_threshold, recipes, security).unionByName(repo_findings(files, repos))
    if commits is not None:
        found = found.unionByName(R.commit_findings(commits if repos is None else commits.join(repos.select("repo").distinct(), "repo", "left_semi")))
    found = S.at_least(S.mixed(found) if mixed else found, min_severity)
    return S.confident(S.of_categories(found, categories), min_confidence)


def grade(spark: SparkSession, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return S.category_grades(spark, findings), S.overall_grade(spark, findings)


def transform(files: DataFrame, **options) -> DataFrame:
    return X.transform(without_ignored(files), **options)


def clean(files: DataFrame, **options) -> DataFrame:
    """Transforms, then scans the result."""
    done = transform(files, **options).withColumn("content", F.col("transformed")).withColumn("size", F.octet_length("content").cast("long"))
    return scan(done.select("repo", "path", "name", "ext", "size", "content"))


learn, calibrate, evaluate = L.baseline, S.calibrate, S.confusion
