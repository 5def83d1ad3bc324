"""Repository detectors: one aggregation by repository each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V
from ..functions.text import ascii_lower, hits, lines, once

C = F.col
CONVENTIONAL = r"^(?:" + "|".join(V.CONVENTIONAL_TYPES) + r")(?:\([^)]+\))?!?:\s"


def finding(df: DataFrame, order: int, detector: str, id_: str, category: str, severity: Column, confidence: Column, path: Column | None = None) -> DataFrame:
    return df.select("repo", (F.lit("") if path is None else path).alias("path"), F.lit(detector).alias("detector"), F.lit(id_).alias("id"), F.lit(category).alias("category"), severity.alias("severity"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(order * 10**12).cast("long").alias("ord"), F.lit(None).cast("string").alias("suggestion"))


def level(high: Column) -> Column:
    return F.when(high, "high").otherwise("medium")


def commit_metrics(commits: DataFrame) -> DataFrame:
    """Cadence, convention and recovery of each repository's commits; gaps of no time do not count."""
    summary = F.regexp_extract(C("message"), r"^([^\n]*)", 1)
    gap = C("ts") - F.lag("ts").over(W.partitionBy("repo").orderBy("ts"))
    c = commits.select("repo", "ts", summary.alias("summary")).withColumn("gap", gap).withColumn("gap", F.when(C("gap") > 0, C("gap").cast("double")))
    recovery = hits(F.lower("summary"), V.RECOVERY) > 0
    m = c.groupBy("repo").agg(F.count("*").alias("commit_count"), F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.avg(F.regexp_like("summary", F.lit(CONVENTIONAL)).cast("double")).alias("conventional"), F.sum(recovery.cast("long")).alias("recovery"))
    several = C("commit_count") >= 2
    return m.select("repo", "commit_count", F.when(~several | (C("n_gaps") < 2) | (C("mean") == 0), F.lit(0.0)).otherwise(C("sd") / C("mean")).alias("cadence_cv"), F.when(several, C("conventional")).otherwise(0.0).alias("conventional_fraction"), F.when(several, C("recovery")).otherwise(0).alias("recovery_count"))


def commit_findings(commits: DataFrame) -> DataFrame:
    m = commit_metrics(commits).where("commit_count >= 6")
    none = (C("recovery_count") == 0) & (C("commit_count") >= 8)
    m = m.withColumn("signals", (C("cadence_cv") < 0.35).cast("int") + (C("conventional_fraction") >= 0.87).cast("int") + none.cast("int")).where("signals >= 2")
    return finding(m, 40, "commit_pattern", "commit_pattern.machine_clean", "commit_pattern", level(C("signals") == 3), 0.5 * (1 - F.least(C("cadence_cv"), F.lit(1.0))) + 0.3 * C("conventional_fraction") + 0.2 * none.cast("int"))


def architecture_metrics(files: DataFrame) -> DataFrame:
    slashed = F.concat(F.lit("/"), "path")
    skipped = F.lit(False)
    for part in ("target", "tests", "book", "docs", "vendor", ".git"):
        skipped = skipped | F.contains(slashed, F.lit(f"/{part}/"))
    f = files.where((C("ext") == "rs") & ~skipped & ~F.endswith("path", F.lit("_test.rs"))).withColumn("n", F.size(lines(C("content"))))
    parts = F.split(F.lower("path"), "/")
    count = lambda pattern, word: F.when(F.contains("content", F.lit(word)), F.regexp_count("content", F.lit(pattern))).otherwise(0)
    m = f.select("repo", "path", "n", F.size(parts).alias("depth"), F.array_intersect(parts, F.array(*map(F.lit, V.LAYERS))).alias("layers"), count(r"(?m)^\s*(pub\s+)?trait\s+\w+", "trait").alias("t"), count(r"(?m)^\s*(pub\s+)?struct\s+\w+", "struct").alias("s"), count(r"(?m)^\s*impl\s+", "impl").alias("i"))
    # The layers of a repository are at most as many as there are indicators.
    m = m.groupBy("repo").agg(F.count("*").alias("source_files"), F.max("depth").alias("depth"), F.size(F.array_distinct(F.flatten(F.collect_set("layers")))).alias("layers"), F.sum("t").alias("traits"), F.sum("s").alias("structs"), F.sum("i").alias("impls"), F.max("n").alias("max_lines"), F.sum("n").alias("total_lines"))
    cover = F.when(C("structs") > 0, C("impls") / C("structs")).otherwise(1.0)
    return m.withColumn("anemic", F.when(cover < 0.5, F.floor(C("structs") * F.greatest(F.lit(0.0), 1 - 2 * cover))).otherwise(0).cast("long"))


def architecture_findings(files: DataFrame) -> DataFrame:
    m = architecture_metrics(files).where("source_files >= 8")
    make = lambda df, k, sev, conf, path=None: finding(df, 50 + k, "architecture", f"ARCH00{k}", "architecture", F.lit(sev), F.lit(conf), path)
    big = files.where((C("ext") == "rs") & (F.size(lines(C("content"))) > 800)).join(m.select("repo"), "repo", "left_semi")
    for part in ("target", "tests", "book", "docs", "vendor", ".git"):
        big = big.where(~F.contains(F.concat(F.lit("/"), "path"), F.lit(f"/{part}/")))
    out = make(m.where("depth < 2"), 1, "medium", 0.75)
    out = out.unionByName(make(m.where("layers < 2 and source_files >= 16"), 2, "medium", 0.70))
    out = out.unionByName(make(big.where(~F.endswith("path", F.lit("_test.rs"))), 3, "high", 0.85, C("path")))
    out = out.unionByName(make(m.where("structs >= 5 and traits / (traits + structs) < 0.02"), 4, "medium", 0.65))
    return out.unionByName(make(m.where("structs >= 5 and anemic / structs > 0.80"), 5, "low", 0.60))


def bundle(files: DataFrame, names: tuple[str, ...], markers: tuple[str, ...]) -> DataFrame:
    """Which of a fixed list of files a repository has, and the markers in them."""
    f = once(files.where(C("path").isin(*names)), lc=ascii_lower(C("content"))).withColumn("h", hits(C("lc"), markers))
    return f.groupBy("repo").agg(F.countDistinct("path").alias("n_files"), F.sum("h").alias("hits"))


def workflow_findings(files: DataFrame) -> DataFrame:
    m = bundle(files, V.WORKFLOW_FILES, V.WORKFLOW_MARKERS).where("n_files >= 3 and hits >= 3")
    return finding(m, 60, "workflow", "workflow.artifact.bundle", "workflow", level((C("n_files") >= 5) & (C("hits") >= 5)), 0.7 * C("n_files") / 7 + 0.3 * C("hits") / 10)


def metadata_findings(files: DataFrame) -> DataFrame:
    m = bundle(files, V.METADATA_FILES, V.METADATA_MARKERS).where("n_files >= 3 and hits >= 5")
    return finding(m, 61, "metadata", "metadata.scaffold.bundle", "metadata", level((C("n_files") >= 4) & (C("hits") >= 8)), 0.6 * C("n_files") / 5 + 0.4 * C("hits") / 12)


def visible(files: DataFrame) -> DataFrame:
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, (".git", "target", ".coraline")))))


def shape(files: DataFrame) -> DataFrame:
    """Counts of code, documents, images and markers by repository."""
    is_readme = C("path") == "README.md"
    doc = C("ext").isin(*V.DOC_EXTENSIONS)
    f = once(visible(files), lc=F.when(doc | is_readme, ascii_lower(F.coalesce("content", F.lit("")))))
    lc = C("lc")
    parts = F.split("path", "/")
    return f.groupBy("repo").agg(
        F.sum(C("ext").isin(*V.CODE_EXTENSIONS).cast("long")).alias("code"), F.sum((doc | C("ext").isin(*V.CONFIG_EXTENSIONS)).cast("long")).alias("non_code"), F.sum(C("ext").isin(*V.IMAGE_EXTENSIONS).cast("long")).alias("images"),
        F.coalesce(F.max(F.when(is_readme, hits(lc, V.PROMOTION_MARKERS))), F.lit(0)).alias("promo"), F.sum(F.when(doc, hits(lc, V.PLACEHOLDERS)).otherwise(0)).alias("placeholders"),
        F.max(F.array_contains(F.slice(parts, 1, F.size(parts) - 1), "tests")).alias("has_tests"), F.max(F.when(is_readme, lc)).alias("readme"),
        F.max(F.when(C("path") == "Cargo.toml", F.regexp_extract("content", r'(?s)\[package\][^\[]*?\bname\s*=\s*"([^"]*)"', 1))).alias("package"),
    )


def promotion_findings(files: DataFrame) -> DataFrame:
    m = shape(files).where("promo >= 4 and images >= 2 and code <= 4")
    return finding(m, 62, "promotion", "promotion.showcase_stack", "promotion", level((C("promo") >= 7) & (C("code") <= 2)), 0.5 * C("promo") / 10 + 0.3 * C("images") / 6 + 0.2 * (4 - C("code")) / 4)


def maintenance_findings(files: DataFrame) -> DataFrame:
    m = shape(files).withColumn("r", F.when(C("code") == 0, C("non_code").cast("double")).otherwise(C("non_code") / C("code"))).where("code <= 3 and non_code >= 5 and placeholders >= 2 and r >= 1.2 and not has_tests")
    return finding(m, 63, "maintenance", "maintenance.hollow_repo", "maintenance", level((C("code") <= 1) & (C("placeholders") >= 3)), 0.5 * C("non_code") / 8 + 0.3 * C("placeholders") / 6 + 0.2 * F.least(C("r"), F.lit(3.0)) / 3)


def name_findings(files: DataFrame) -> DataFrame:
    m = shape(files).where("package <> ''")
    tokens = F.split(F.lower("package"), "[-_]")
    m = m.withColumn("generic", F.size(F.filter(tokens, lambda t: t.isin(*V.GENERIC_NAMES))))
    dashed = F.replace(F.lower("package"), F.lit("_"), F.lit("-"))
    m = m.withColumn("dashed", dashed).withColumn("repeats", F.coalesce(((F.length("readme") - F.length(F.replace("readme", C("dashed"), F.lit("")))) / F.length("dashed")).cast("int"), F.lit(0)))
    m = m.where("generic >= 2 and repeats >= 3 and code <= 4")
    return finding(m, 64, "name_credibility", "name.discovery_pollution", "name_credibility", level((C("generic") >= 3) & (C("repeats") >= 5) & (C("code") <= 2)), 0.4 * C("generic") / 5 + 0.4 * C("repeats") / 8 + 0.2 * (4 - C("code")) / 4)

