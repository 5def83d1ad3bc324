"""Commands over folders: `python -m inkstrata scan|grade|transform|clean|learn|calibrate|eval|recipes|status|plan ...`.

Each is the function of the same name over the files below a folder; what is printed has a bounded number of lines, and
`--out` writes a whole report as text files instead.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import history as H
from .operators import learn as L
from .operators import rules as U
from .operators import scores as S
from .sources import corpus, git, sinks

#: Lines of a report that are printed; `--out` has no bound.
SHOWN = 10_000


def session() -> SparkSession:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def recipes_of(root: Path, args) -> list[U.Recipe]:
    found = U.discover(("user", Path.home() / ".config/inkstrata/recipes"), ("repository", root / ".inkstrata/recipes"))
    return U.select(found, tuple(args.include or ()), tuple(args.exclude or ()))


def files_of(spark: SparkSession, root: Path) -> DataFrame:
    files = corpus.directory(spark, str(root), root.name).where(~F.startswith("path", F.lit(".git/")))
    ignore = corpus.project_root(root) / ".inkstrataignore"
    return corpus.prune(files, ignore.read_text().splitlines()) if ignore.exists() else files


def findings_of(spark: SparkSession, root: Path, args) -> DataFrame:
    versioned = (root / ".git").exists()
    repos = spark.createDataFrame([(root.name,)] if versioned else [], "repo string")
    commits = git.commits(spark, str(root), repo=root.name) if versioned else None
    threshold = L.comment_threshold(L.load(spark, str(root / ".inkstrata/baseline")))
    return api.scan(files_of(spark, root), commits, args.severity, args.mixed, threshold, recipes_of(root, args), not args.no_security, repos, tuple(args.category or ()), args.confidence)


def show(lines: DataFrame, out: str | None) -> None:
    if out:
        lines.select("value").write.mode("overwrite").text(out)
    else:
        print("\n".join(r.value for r in lines.limit(SHOWN).collect()))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkstrata", description=__doc__)
    parser.add_argument("command", choices=("scan", "grade", "transform", "clean", "learn", "calibrate", "eval", "recipes", "status", "plan"))
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--format", choices=("text", "json", "sarif", "annotations"), default="text")
    parser.add_argument("--severity", choices=("low", "medium", "high"), default="low")
    parser.add_argument("--fail-on", choices=("low", "medium", "high"))
    parser.add_argument("--min-grade")
    parser.add_argument("--category", action="append")
    parser.add_argument("--confidence", type=float, default=0.0)
    parser.add_argument("--include", action="append", help="recipes by name")
    parser.add_argument("--exclude", action="append", help="recipes by name")
    parser.add_argument("--detector", action="append", help="transforms by name")
    parser.add_argument("--mixed", action="store_true")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--no-security", action="store_true")
    parser.add_argument("--apply", help="file for calibrated settings")
    parser.add_argument("--labels", help="Parquet of (path, expected) for eval")
    parser.add_argument("--window", action="append", help="active hours HH:MM-HH:MM of a plan")
    parser.add_argument("--now", type=int, default=0, help="seconds at which a plan begins")
    parser.add_argument("--out", help="folder for the whole output")
    args = parser.parse_args(argv)
    root = Path(args.path).resolve()
    if not corpus.allowed(root):
        parser.error(f"{root} may not be scanned")
    spark = session()
    if args.command == "recipes":
        show(U.listing(spark, recipes_of(root, args)).select(F.concat_ws("\t", "name", "source", "location", F.col("n_patterns").cast("string")).alias("value")), args.out)
    elif args.command in ("scan", "grade", "calibrate", "eval"):
        found = corpus.cut(findings_of(spark, root, args))
        if args.command == "grade":
            show(sinks.grade_report(spark, found).orderBy("place"), args.out)
            if args.min_grade and not S.meets(S.overall_grade(spark, found), args.min_grade).first().meets:
                return 1
        elif args.command == "calibrate":
            show(S.calibrate(found).select(F.to_json(F.struct("*")).alias("value")), args.out)
            if args.apply:
                sinks.calibration(found, args.apply, L.comment_threshold(L.load(spark, str(root / ".inkstrata/baseline"))))
        elif args.command == "eval":
            flagged = S.at_least(found, "medium").select("path").distinct().withColumn("predicted", F.lit(True))
            labels = spark.read.parquet(args.labels).join(flagged, "path", "left")
            show(S.confusion(labels.select("expected", F.coalesce("predicted", F.lit(False)).alias("predicted"))).select(F.to_json(F.struct("*")).alias("value")), args.out)
        else:
            reports = {"text": lambda: sinks.text_report(found, args.explain), "json": lambda: sinks.json_document(found, args.explain), "sarif": lambda: sinks.sarif_document(found)}
            show(reports.get(args.format, lambda: sinks.annotations(found).select(F.col("annotation").alias("value")))(), args.out)
        return int(bool(args.fail_on) and S.gate(found, args.fail_on))
    elif args.command == "transform":
        done = corpus.cut(api.transform(files_of(spark, root), recipes=recipes_of(root, args), detectors=tuple(args.detector or ())).where("changed"))
        if args.out:
            done.select("repo", "path", "transformed").write.mode("overwrite").parquet(args.out)
        show(done.select(F.format_string("%s: %d replaced, %d removed", "path", "n_replaced", "n_removed").alias("value")).orderBy("value"), None)
    elif args.command == "clean":
        show(sinks.text_report(corpus.cut(api.clean(files_of(spark, root), recipes=recipes_of(root, args)))), args.out)
    elif args.command == "learn":
        L.save(api.learn(files_of(spark, root)), str(root / ".inkstrata/baseline"))
    else:
        commits = H.pending(git.commits(spark, str(root), repo=root.name))
        plan = H.schedule(H.actions(H.overlap_groups(commits)), args.now, windows=args.window or [])
        if args.command == "status":
            show(H.queue_status(plan.withColumn("completed", F.lit(False)), args.now).select(F.to_json(F.struct("*")).alias("value")), args.out)
        else:
            show(plan.orderBy("target", "session", "grp").select(F.to_json(F.struct("session", "grp", "action", "scope", "message", "oids", "target")).alias("value")), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
