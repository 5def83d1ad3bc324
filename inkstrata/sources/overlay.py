"""Deterministic code, repository and commit views over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .corpus import FILES

EXTENSIONS = ("rs", "py", "go", "ts", "cs", "zig", "cpp", "md")
_NARRATION = "\n".join(f"// This function is a helper to compute step {i}\nlet a{i} = {i};\n// This function is a helper for step {i}" for i in range(8))
_TESTS = "\n".join(f"fn test_sum_{i}() {{\n    assert_eq!(sum({i}), {i});\n}}\ndef test_sum_{i}():\n    assert sum({i}) == {i}" for i in range(6))
_UNIFORM = "\n".join(f"/// Adds {i}.\npub fn add_{i}(x: i32) -> i32 {{\n    x + {i}\n}}\n" for i in range(5)) + "/// Outer.\npub fn outer(x: i32) -> i32 {\n    fn inner(y: i32) -> i32 { y }\n    inner(x)\n}\n"
_RISKY = ("password = \"hunter2secret\"", "DEBUG = True", "h = hashlib.md5(data)")
SNIPPETS = (
    "Plain notes about the weather and the garden.",
    "However, this robust and seamless tool will leverage a comprehensive realm.\nThus we delve into the landscape; moreover it is pivotal and robust.",
    "However robust.\nA seamless however plan.",
    "However robust.\nA seamless plan.",
    "This underscores the importance of enthusiasm. Enthusiasm for a seamless integration is vital.",
    _NARRATION,
    _TESTS,
    "User: please help\nAssistant: here's the updated file\nplain line",
    "console.log(x)\npip install thing\nnpm install other\nlet y = 1",
    "# Installation\n## Usage\n## Features\n# Roadmap\n# License\nFeel free to open an issue.\nPull requests are welcome, made with care.",
    "\n".join(_RISKY),
    "\n".join(f"# {V.IGNORE_NEXT}\n{line}" for line in _RISKY),
    f"// {V.IGNORE_FILE}\nHowever, this robust and seamless tool will leverage a comprehensive realm.",
    "robust utilize\nleverage\nseamless\n" + "\n" * 12 + "harness\n" + "\n" * 30 + "pivotal\n" + "\n" * 30 + "vital",
    _UNIFORM,
    "first line\r\nrobust_x and robusté and x_robust and robust\r\nIn order to   test ,  spaces .  \r\nLet's explore best practices",
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document: a snippet, then the document's text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    readme = F.col("doc_id") % 40 == 7
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), ((F.floor(F.col("doc_id") / 8)) % 16 + 1).cast("int"))
    d = d.withColumn("ext", ext).withColumn("content", F.concat(snippet, F.lit("\n"), F.coalesce("text", F.lit(""))))
    name = F.when(readme, "README.md").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("ext")))
    path = F.when(readme, F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), name)).otherwise(F.concat("source", F.lit("/src/"), name))
    return d.select(F.col("source").alias("repo"), path.alias("path"), name.alias("name"), "ext", F.octet_length("content").cast("long").alias("size"), "content")


_POLICY = {f: "# Policy\nAll contributors are expected to follow the code of conduct.\nBy participating in this project you agree. Security policy: report a vulnerability." for f in V.METADATA_FILES[:4]}
_WORKFLOW = {f: "# automatically generated\nWelcome contributors, thanks for taking the time. Please fill out the template. Continuous integration." for f in V.WORKFLOW_FILES[:5]}
_PROMO = {"README.md": "A revolutionary, game-changing, enterprise-ready showcase demo. New and instant.", "a.png": "", "b.svg": "", "main.rs": "fn main() {}"}
_HOLLOW = {"a.md": "coming soon, todo", "b.md": "tbd: to be added", "c.txt": "placeholder", "d.toml": "x = 1", "e.yaml": "y: 1", "main.py": "pass"}
_NAME = {"Cargo.toml": '[package]\nname = "ai-app-generator"\n', "README.md": "ai-app-generator is here. Use ai-app-generator. ai-app-generator!", "main.rs": "fn main() {}"}
#: Small extra files of a repository by the rest of its number divided by six.
BUNDLES: tuple[dict[str, str], ...] = ({}, _POLICY, _WORKFLOW, _PROMO, _HOLLOW, _NAME)


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant small files for each source."""
    repos = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("repo")).where("source is not null").distinct()
    rows = [(k, path, text) for k, bundle in enumerate(BUNDLES) for path, text in bundle.items()]
    fixed = spark.createDataFrame(rows, "k int, path string, content string")
    name = F.element_at(F.split("path", "/"), -1)
    # The bundles are a constant of a few rows.
    out = repos.withColumn("k", F.substring("repo", 4, 9).cast("int") % 6).join(F.broadcast(fixed), "k")
    return out.select("repo", "path", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("ext"), F.octet_length("content").cast("long").alias("size"), "content").select(*FILES.fieldNames())


def commits(spark: SparkSession, sf_dir: str, sessions: bool = False) -> DataFrame:
    """Commits from events: by user, every fifth with a machine's cadence; or by event type, for sessions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    from pyspark.sql.window import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("n", n)
    machine = F.col("user_id") % 5 == 0
    secs = F.when(machine, F.lit(1704067200) + (F.col("n") - 1) * 3600).otherwise(F.unix_timestamp(F.date_trunc("second", "ts"))).cast("long")
    human = F.create_map(*[F.lit(x) for kv in {"click": "feat: add view", "view": "docs: notes", "signup": "update things", "purchase": "refactor(core): tidy", "error": "oops wrong path"}.items() for x in kv])
    message = F.when(machine, F.concat(F.lit("feat(x): change "), F.col("n").cast("string"))).otherwise(human[F.col("event_type")])
    return e.select(
        (F.col("event_type") if sessions else F.col("user_id").cast("string")).alias("repo"), F.col("event_id").cast("string").alias("oid"), "event_id", secs.alias("ts"),
        ((F.col("user_id") % 5 - 2) * 60).cast("int").alias("tz_offset_min"), F.col("user_id").cast("string").alias("author"), message.alias("message"),
        F.array(F.concat(F.lit("src/"), "event_type", F.lit(".rs")), F.concat(F.lit("docs/"), (F.col("event_id") % 3).cast("string"), F.lit(".md"))).alias("files"),
    )
