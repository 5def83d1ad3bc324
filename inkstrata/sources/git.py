"""Git history as a Spark data source: `spark.read.format("inkstrata_git").option("path", folder).load()`.

The log of a branch is cut into ranges of commits that are read each by a task of its own. The repository must be
visible at the same path on the driver and on the executors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, oid string, seq long, ts long, tz_offset_min int, author string, message string, files array<string>"
#: Separators of records and of fields in the log that is asked for.
RECORD, FIELD = "\x1e", "\x1f"
FORMAT = RECORD.join(["", FIELD.join(["%H", "%ct", "%cd", "%an", "%B", ""])])


def git(path: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-C", path, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise ValueError(f"git {args[0]} in {path}: {done.stderr.strip()}")
    return done.stdout


class Range(InputPartition):
    def __init__(self, skip: int, most: int):
        self.skip, self.most = skip, most


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.branch = options["path"], options.get("branch", "HEAD")
        self.repo, self.each = options.get("repo", Path(self.path).resolve().name), int(options.get("commitsPerPartition", "5000"))

    def partitions(self) -> list[Range]:
        if not git(self.path, "rev-list", "--all", "--max-count=1").strip():
            return [Range(0, 0)]
        n = int(git(self.path, "rev-list", "--count", self.branch))
        return [Range(at, self.each) for at in range(0, n, self.each)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.most:
            return
        # Merges are told by what they change against their first parent.
        log = git(self.path, "log", "--date-order", f"--skip={partition.skip}", f"--max-count={partition.most}", "--date=format:%z", f"--format={FORMAT}", "--name-only", "--diff-merges=first-parent", self.branch)
        for k, record in enumerate(log.split(RECORD)[1:]):
            oid, ts, zone, author, message, files = record.split(FIELD, 5)
            minutes = (int(zone[1:3]) * 60 + int(zone[3:5])) * (-1 if zone[0] == "-" else 1)
            yield self.repo, oid, partition.skip + k, int(ts), minutes, author, message.strip() or "<no message>", [f for f in files.split("\n") if f]


class GitLog(DataSource):
    """Commits from the tip backwards: seq is 0 at the tip."""

    @classmethod
    def name(cls) -> str:
        return "inkstrata_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options)


def commits(spark: SparkSession, path: str, branch: str = "HEAD", repo: str | None = None, per_partition: int = 5000) -> DataFrame:
    spark.dataSource.register(GitLog)
    reader = spark.read.format("inkstrata_git").option("path", path).option("branch", branch).option("commitsPerPartition", per_partition)
    return (reader.option("repo", repo) if repo else reader).load()


def repositories(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo) of the named folders that are under version control, for the repository gate."""
    return spark.createDataFrame([(name,) for name, root in roots.items() if (Path(root) / ".git").exists()], "repo string")


def staged(spark: SparkSession, path: str) -> DataFrame:
    """Paths that the index holds and the last commit does not, or not so."""
    names = git(path, "diff", "--cached", "--name-only", "--diff-filter=ACMR").split("\n")
    return spark.createDataFrame([(n,) for n in names if n], "path string").select(F.col("path"))
