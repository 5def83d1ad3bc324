"""Sources: directories and tables as `files`, lines, ignore rules, directives, and commit tables."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.text import lines

FILES = T.StructType([T.StructField(n, T.LongType() if n == "size" else T.StringType()) for n in ("repo", "path", "name", "ext", "size", "content")])


def with_names(df: DataFrame) -> DataFrame:
    """Fills name and ext from path."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("name", name).withColumn("ext", F.regexp_extract(name, r"\.([^.]+)$", 1))


def directory(spark: SparkSession, root: str, repo: str = "repo", glob: str | None = None) -> DataFrame:
    """All UTF-8 files below root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = F.regexp_replace("path", "^file:", "")
    df = reader.load(root).select(F.lit(repo).alias("repo"), F.regexp_replace(base, "^" + re.escape(root.rstrip("/")) + "/", "").alias("path"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    return with_names(df.where(F.is_valid_utf8("content"))).select(*FILES.fieldNames())


def from_table(df: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    """Any table with a text column as files; columns are SQL expressions."""
    out = df.select(F.expr(repo).alias("repo"), F.expr(path).alias("path"), F.expr(content).alias("content"))
    return with_names(out).withColumn("size", F.octet_length("content").cast("long")).select(*FILES.fieldNames())


def file_list(spark: SparkSession, path: str, extensions: tuple[str, ...] = V.CODE_EXTENSIONS + ("md", "toml")) -> DataFrame:
    """Paths of an index file, one a line, without comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).where((line != "") & ~F.startswith(line, F.lit("#")) & F.regexp_extract(line, r"\.([^.]+)$", 1).isin(*extensions))


def listed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files that an index lists."""
    return files.join(paths.select("path").distinct(), "path", "left_semi").select(*FILES.fieldNames())


def project_root(start: str | Path, config: str = ".inkstrata.toml", ignore: str = ".inkstrataignore") -> Path:
    """The nearest folder, from start upwards, with a configuration, an ignore file or a repository; else start itself."""
    here = Path(start).resolve()
    here = here if here.is_dir() else here.parent
    return next((at for at in (here, *here.parents) if any((at / x).exists() for x in (config, ignore, ".git"))), here)


def allowed(path: str | Path, prefixes: tuple[str, ...] = ("/etc", "/proc", "/sys", "/dev", "/root/.ssh"), segments: tuple[str, ...] = (".ssh", ".gnupg", ".aws")) -> bool:
    """Whether a service may be asked to scan a path: none below denied folders or with a denied part, links resolved."""
    at = Path(path).resolve()
    return not any(at.is_relative_to(p) for p in prefixes) and not set(segments) & set(at.parts)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster shares, named by spark.checkpoint.dir.

    Only a session in one process, as in tests, may do without that setting: its own temporary folder is shared by all.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkstrata-"))
    return df.checkpoint(eager=True)


def glob_regex(glob: str) -> str:
    """A file glob, whose * crosses slashes, as a regular expression for full matches."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : end].replace("!", "^", 1) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(g)[2:-2] for g in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return rf"\A{out}\Z"


def ignore_regex(rule: str) -> tuple[str, bool]:
    """A gitignore rule as (regular expression on relative paths, whether it excludes)."""
    excludes = not rule.startswith("!")
    rule = rule.removeprefix("!")
    anchored = "/" in rule.rstrip("/")
    folder = rule.endswith("/")
    body = ""
    for part in re.split(r"(\*\*/|/\*\*|\*|\?)", rule.strip("/")):
        body += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return rf"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", excludes


def prune(files: DataFrame, rules: list[str]) -> DataFrame:
    """Files that the last matching ignore rule, if any, does not exclude."""
    ignored = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, excludes = ignore_regex(rule.strip())
            ignored = F.when(F.regexp_like("path", F.lit(pattern)), F.lit(excludes)).otherwise(ignored)
    return files.where(~ignored)


def without_ignored(files: DataFrame) -> DataFrame:
    """Files without the ignore-file directive; a file without content has none."""
    return files.where(~F.contains(F.coalesce("content", F.lit("")), F.lit(V.IGNORE_FILE)))


def hushed(all_lines: Column) -> Column:
    """The lines that follow an ignore-next-line directive."""
    return F.filter(F.transform(all_lines, lambda x, i: F.when(F.contains(x, F.lit(V.IGNORE_NEXT)), i + 2)), lambda x: x.isNotNull())


def suppressed_lines(files: DataFrame) -> DataFrame:
    """(repo, path, line): lines that follow an ignore-next-line directive."""
    return files.select("repo", "path", F.explode(hushed(lines(F.col("content")))).alias("line"))


def suppress(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings that do not begin on a suppressed line; those without lines stay."""
    gone = suppressed_lines(files)
    return findings.join(gone, (findings.repo == gone.repo) & (findings.path == gone.path) & (findings.line_start == gone.line), "left_anti")
