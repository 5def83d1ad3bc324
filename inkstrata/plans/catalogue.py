"""Queries of the engine's own operators by name, and their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import vocabulary as V
from ..functions.text import ascii_lower, hits
from ..operators import files as D
from ..operators import history as H
from ..operators import learn as L
from ..operators import repos as R
from ..operators import rules as U
from ..operators import scores as S
from ..operators import transforms as X
from ..sources import corpus, overlay, sinks
from . import oracles as O

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.prepared(overlay.code_files(spark, sf_dir))


def long(*names: str):
    return [C(n).cast("long").alias(n) for n in names]


def rounded(*names: str, digits: int = 6):
    return [F.round(C(n).cast("double"), digits).alias(n) for n in names]


def brief(found: DataFrame, digits: int = 6) -> DataFrame:
    return found.select("repo", "path", "severity", *rounded("confidence", digits=digits))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors over files, repositories and commits, with the ignore directives applied."""
    found = api.scan(overlay.code_files(spark, sf_dir), overlay.commits(spark, sf_dir))
    return found.unionByName(api.repo_findings(overlay.repo_files(spark, sf_dir)))


@query(O.SCAN)
def scan(spark, sf_dir):
    return whole(spark, sf_dir).select("repo", "path", "detector", "id", "category", "severity", *rounded("confidence", digits=4), "line_start", "line_end")


@query(O.LEXICAL)
def lexical_metrics(spark, sf_dir):
    return D.lexical(code(spark, sf_dir).where("lang <> 'unknown'")).select("repo", "path", *long("matches", "terms", "first_line", "last_line"))


@query(O.LEXICAL_FINDINGS)
def lexical_findings(spark, sf_dir):
    return D.lexical_findings(code(spark, sf_dir)).select("repo", "path", "severity", *rounded("confidence"), "line_start", "line_end")


@query(O.COMMENTS)
def comment_metrics(spark, sf_dir):
    return D.comments(code(spark, sf_dir).where("lang <> 'unknown'")).select("repo", "path", *long("non_empty", "comment_lines", "tutorial"), *rounded("density", "prefix_ratio"))


@query(O.COMMENT_FINDINGS)
def comment_findings(spark, sf_dir):
    return brief(D.comment_findings(code(spark, sf_dir)), 4)


@query(O.PROMPT)
def prompt_findings(spark, sf_dir):
    return brief(D.prompt_findings(code(spark, sf_dir)))


@query(O.CONVERSATIONS)
def conversation_markers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", hits(ascii_lower(F.coalesce("text", F.lit(""))), V.PROMPT).alias("markers"))


@query(O.IDIOM)
def idiom_findings(spark, sf_dir):
    return brief(D.idiom_findings(code(spark, sf_dir)))


@query(O.README)
def readme_findings(spark, sf_dir):
    return brief(D.readme_findings(code(spark, sf_dir)))


@query(O._tests())
def test_shape_metrics(spark, sf_dir):
    return D.test_shape(code(spark, sf_dir)).select("repo", "path", *long("test_count"), *rounded("prefix_ratio", "assert_density"))


@query(O.STRUCTURE)
def structure_metrics(spark, sf_dir):
    s = D.structure(code(spark, sf_dir))
    return s.select("repo", "path", "lang", *long("n_lines", "function_count"), *rounded("length_cv", "doc_coverage", "pub_fraction"))


@query(O.SECURITY)
def security_findings(spark, sf_dir):
    return U.security_findings(code(spark, sf_dir)).select("repo", "path", "id", "severity", "confidence", C("line_start").alias("line"))


def recipe(spark, sf_dir, name: str) -> DataFrame:
    return U.recipe_findings(code(spark, sf_dir), U.select(U.builtin(), (name,)))


@query(O.RECIPE_WORDS)
def recipe_words(spark, sf_dir):
    return recipe(spark, sf_dir, "slop-vocabulary").where("kind = 'word'").groupBy("repo", "path", C("line_start").alias("line"), C("matched").alias("word")).agg(F.count("*").alias("n"))


@query(O.RECIPE_PHRASES)
def recipe_phrases(spark, sf_dir):
    return recipe(spark, sf_dir, "slop-vocabulary").where("kind = 'phrase'").groupBy("repo", "path", C("line_start").alias("line"), C("matched").alias("phrase")).agg(F.count("*").alias("n"))


@query(O.RECIPE_REGEX)
def recipe_regex(spark, sf_dir):
    return recipe(spark, sf_dir, "comment-patterns").select("repo", "path", C("line_start").alias("line"), C("matched").alias("name"))


@query(O.RECIPE_CONTEXTUAL)
def recipe_contextual(spark, sf_dir):
    return recipe(spark, sf_dir, "phrase-patterns").where("kind = 'contextual'").select("repo", "path", C("line_start").alias("line"), C("matched").alias("name"))


@query(O.CLUSTERS)
def cluster_boost(spark, sf_dir):
    found = U.boosted(recipe(spark, sf_dir, "slop-vocabulary"), U.builtin())
    return found.groupBy("repo", "path", F.floor((C("line_start") - 1) / 15).alias("bucket")).agg(F.count("*").alias("n"), F.max("boosted").alias("boosted"))


@query(O.SUPPRESSED)
def suppress_next_line(spark, sf_dir):
    files = overlay.code_files(spark, sf_dir)
    return corpus.suppress(U.security_findings(D.prepared(files)), files).select("repo", "path", "id", C("line_start").alias("line"))


@query(O.IGNORED)
def ignore_file(spark, sf_dir):
    hit = F.contains("content", F.lit(V.IGNORE_FILE))
    return overlay.code_files(spark, sf_dir).groupBy("repo").agg(F.count_if(hit).alias("ignored"), F.count_if(~hit).alias("scanned"))


@query(O.GLOB)
def glob_filter(spark, sf_dir):
    rule = U.Pattern("contextual", "x", "x", "low", applies_to=("README*.md", "*README*.md"), excludes=("*/d7/*",))
    return overlay.code_files(spark, sf_dir).where(U.applies(rule)).groupBy("repo").agg(F.count("*").alias("n"))


@query(O.ARCHITECTURE)
def repo_architecture(spark, sf_dir):
    return R.architecture_metrics(overlay.code_files(spark, sf_dir)).select("repo", *long("source_files", "depth", "traits", "structs", "impls", "max_lines"))


def _repo(name: str, sql: str, detect) -> None:
    def run(spark, sf_dir):
        return detect(overlay.repo_files(spark, sf_dir)).select("repo", "severity", *rounded("confidence"))

    run.__name__ = name
    query(sql)(run)


_repo("repo_workflow", O.WORKFLOW, R.workflow_findings)
_repo("repo_metadata", O.METADATA, R.metadata_findings)
_repo("repo_promotion", O.PROMOTION, R.promotion_findings)
_repo("repo_maintenance", O.MAINTENANCE, R.maintenance_findings)
_repo("repo_name", O.NAME, R.name_findings)


@query(O.COMMIT_METRICS)
def commit_metrics(spark, sf_dir):
    return R.commit_metrics(overlay.commits(spark, sf_dir)).select("repo", *long("commit_count"), *rounded("cadence_cv", "conventional_fraction"), *long("recovery_count"))


@query(O.COMMIT_FINDINGS)
def commit_findings(spark, sf_dir):
    return R.commit_findings(overlay.commits(spark, sf_dir)).select("repo", "severity", *rounded("confidence", digits=4))


@query(O.COMMIT_STATS)
def commit_stats(spark, sf_dir):
    s = H.commit_stats(overlay.commits(spark, sf_dir))
    return s.select("repo", "commits", *rounded(*[c for c in s.columns if c not in ("repo", "commits")]))


@query(O.SESSIONS)
def sessions(spark, sf_dir):
    return H.sessions(overlay.commits(spark, sf_dir, sessions=True)).groupBy("repo", C("session").cast("long").alias("session")).agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(O.GROUPS)
def overlap_groups(spark, sf_dir):
    g = H.overlap_groups(overlay.commits(spark, sf_dir, sessions=True))
    return g.select("repo", "session", "grp", F.array_join("oids", ",").alias("oids"), F.array_join(F.array_sort("files"), ",").alias("files"), "n_commits")


@query(O.REPLAY)
def replay_actions(spark, sf_dir):
    plan = H.schedule(H.actions(H.overlap_groups(overlay.commits(spark, sf_dir, sessions=True))), O.NOW, 5, 0.25)
    return plan.select("repo", "session", "grp", "n_commits", "action", "scope", "target")


@query(O.TOUCHES)
def file_touch_counts(spark, sf_dir):
    return H.file_touches(overlay.commits(spark, sf_dir))


@query(O.QUEUE)
def queue_status(spark, sf_dir):
    plan = overlay.commits(spark, sf_dir).select("repo", C("ts").alias("target"), (C("event_id") % 4 == 0).alias("completed"))
    return H.queue_status(plan, O.NOW)


@query(O.SCOPES)
def scope_inference(spark, sf_dir):
    return overlay.commits(spark, sf_dir).select("oid", H.scope(C("files")).alias("scope"), H.bare_subject(C("message")).alias("subject"))


@query(O.SUMMARY)
def summary(spark, sf_dir, findings=whole):
    return S.summary(findings(spark, sf_dir)).select("total", "low", "medium", "high", *rounded("ai_probability", digits=4))


@query(O.CONTRIBUTIONS)
def explain_categories(spark, sf_dir, findings=whole):
    return S.contributions(findings(spark, sf_dir)).select("category", "n", *rounded("contribution", digits=4))


@query(O.EVIDENCE)
def explain_top_evidence(spark, sf_dir, findings=whole):
    return S.evidence(findings(spark, sf_dir)).select("repo", "path", "id", *rounded("contribution", digits=4))


@query(O.GRADE_CATEGORIES)
def grade_categories(spark, sf_dir, findings=whole):
    return S.category_grades(spark, findings(spark, sf_dir)).select("grade_category", "n", *rounded("score", digits=2), "grade")


@query(O.GRADE_OVERALL)
def grade_overall(spark, sf_dir, findings=whole):
    return S.overall_grade(spark, findings(spark, sf_dir)).select(*rounded("score", digits=2), "grade")


@query(O.MIXED)
def mixed_dedup(spark, sf_dir, findings=whole):
    m = S.mixed(findings(spark, sf_dir))
    return m.select("repo", "path", "category", F.floor((C("line_start") - 1) / 80).alias("segment"), F.when(C("severity") == "high", 2).when(C("severity") == "medium", 1).otherwise(0).alias("best"))


@query(O.ROLLUP)
def findings_rollup(spark, sf_dir, findings=whole):
    return S.rollup(findings(spark, sf_dir)).drop("level")


@query(O.CALIBRATE)
def calibrate(spark, sf_dir, findings=whole):
    return S.calibrate(findings(spark, sf_dir))


@query(O.FILTERED)
def severity_filter(spark, sf_dir, findings=whole):
    return S.at_least(findings(spark, sf_dir), "medium").groupBy("severity").agg(F.count("*").alias("n"))


@query(O.EVAL)
def eval_confusion(spark, sf_dir, findings=whole):
    """Labelled documents against the findings in their files: poor ones are expected to have some of medium severity."""
    number = F.regexp_extract("path", r"(?:/src/f|/d)([0-9]+)", 1).try_cast("long")
    flagged = S.at_least(findings(spark, sf_dir), "medium").select(number.alias("doc_id")).where("doc_id is not null").distinct().withColumn("found", F.lit(True))
    x = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id").join(flagged, "doc_id", "left")
    m = S.confusion(x.select((C("quality") == 0).alias("expected"), F.coalesce("found", F.lit(False)).alias("predicted")))
    return m.select("tp", "tn", "fp", "fn", *rounded("precision", "recall", "accuracy"))


@query(O.BREAKDOWN)
def score_breakdown(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (C("doc_id") % 5).alias("a"), (C("doc_id") % 3).alias("b"), (C("doc_id") % 4).alias("c"))
    return S.score_breakdown(d).select("doc_id", "level")


@query(O.BASELINE)
def baseline(spark, sf_dir):
    return L.baseline(overlay.code_files(spark, sf_dir)).select("files", *rounded("comment_density", "doc_ratio", "terms_per_100_lines", "threshold"))


@query(O.NORMALISE)
def normalise_text(spark, sf_dir):
    return overlay.code_files(spark, sf_dir).select("repo", "path", F.md5(X.normalise(C("content")).cast("binary")).alias("digest"))


@query(O.THIN)
def thin_comments(spark, sf_dir):
    return X.thin_comments(overlay.code_files(spark, sf_dir)).select("repo", "path", F.md5(C("thinned").cast("binary")).alias("digest"), "removed_comments")


@query(O.SWAP)
def recipe_transform(spark, sf_dir):
    return X.replace_recipes(overlay.code_files(spark, sf_dir)).select("repo", "path", F.md5(C("replaced").cast("binary")).alias("digest"), "replacements")


@query(O.CLEAN)
def readme_transform(spark, sf_dir):
    return X.clean_readme(overlay.code_files(spark, sf_dir).where("ext = 'md'")).select("repo", "path", F.md5(C("cleaned").cast("binary")).alias("digest"), "removed_lines")


@query(O.TRANSFORMED)
def transform_summary(spark, sf_dir):
    return X.transform_summary(api.transform(overlay.code_files(spark, sf_dir)))


@query(O.SARIF)
def sarif_rules(spark, sf_dir, findings=whole):
    return sinks.sarif_rules(findings(spark, sf_dir)).select("rule", "rule_index", "n")


@query(O.SARIF_REPORT)
def sarif_report(spark, sf_dir, findings=whole):
    return sinks.sarif_report(findings(spark, sf_dir))


@query(O.JSON_REPORT)
def json_report(spark, sf_dir, findings=whole):
    return sinks.json_report(findings(spark, sf_dir))


@query(O.GRADE_REPORT)
def grade_report(spark, sf_dir, findings=whole):
    return sinks.grade_report(spark, findings(spark, sf_dir))


@query(O.CATEGORIES)
def category_filter(spark, sf_dir, findings=whole):
    return S.confident(S.of_categories(findings(spark, sf_dir), ("security", "comment"))).groupBy("repo", "category").agg(F.count("*").alias("n"))


@query(O.ANNOTATIONS)
def annotations(spark, sf_dir, findings=whole):
    return sinks.annotations(findings(spark, sf_dir)).select("repo", "annotation")
