"""Reports as documents, filters, gates and the functions of the SQL surface."""

import json

import pytest

from inkstrata import api, sql
from inkstrata.functions.text import language
from inkstrata.operators import learn as L
from inkstrata.operators import scores as S
from inkstrata.sources import corpus, sinks

SLOP = "However, this robust and seamless tool will leverage a comprehensive realm.\nThus we delve into the landscape; moreover it is pivotal and robust.\npassword = \"hunter2secret\"\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", "a.rs", SLOP), ("r", "b.py", "x = 1\n"), ("r", "c%.py", 'q = "x"\npassword = "hunter2secret"\n'), ("r", "d.md", None), ("s", "a.rs", SLOP)]
    return corpus.with_names(spark.createDataFrame(rows, "repo string, path string, content string")).selectExpr("repo", "path", "name", "ext", "coalesce(octet_length(content), 0L) AS size", "content")


@pytest.fixture(scope="module")
def found(files):
    return corpus.cut(api.scan(files))


def text(df):
    return "\n".join(r.value for r in df.collect())


def test_json(found):
    whole = json.loads(text(sinks.json_document(found)))
    assert set(whole) == {"summary", "findings", "explainability"} and whole["summary"]["total"] == len(whole["findings"]) == found.count()
    assert [(f["repo"], f["path"]) for f in whole["findings"]] == sorted((f["repo"], f["path"]) for f in whole["findings"])
    assert "explainability" not in json.loads(text(sinks.json_document(found, explain=False)))
    none = json.loads(text(sinks.json_document(found.limit(0))))
    assert none["findings"] == [] and none["summary"]["total"] == 0


def test_sarif(found):
    run = json.loads(text(sinks.sarif_document(found)))["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert len(rules) == len(set(rules)) and len(run["results"]) == found.count() == run["properties"]["total"]
    first = list(dict.fromkeys(r["ruleId"] for r in run["results"]))
    assert first == rules and all(rules[r["ruleIndex"]] == r["ruleId"] for r in run["results"])
    words = [r for r in run["results"] if r["ruleId"].endswith(":word:robust")]
    assert words and all(r["fixes"][0]["description"]["text"] == "sturdy" and r["properties"]["autoFixable"] for r in words)
    levels = {"high": "error", "medium": "warning", "low": "note"}
    assert sorted(r["level"] for r in run["results"]) == sorted(levels[r.severity] for r in found.collect())


def test_text_and_annotations(found):
    lines = text(sinks.text_report(found, explain=True)).split("\n")
    assert len(lines) == found.count() + 1 + 5 and lines[found.count()].startswith(f"{found.count()} finding(s)")
    notes = [r.annotation for r in sinks.annotations(found).collect()]
    assert any("file=c%25.py,line=2,title=inkstrata[security]: SEC003::" in n for n in notes) and sum(n.startswith("::notice") for n in notes) == 1


def test_grades(spark, found):
    categories, overall = api.grade(spark, found)
    lines = [r.value for r in sinks.grade_report(spark, found).orderBy("place").collect()]
    assert len(lines) == categories.where("n > 0").count() + 1 and lines[-1].split()[2] == overall.first().grade
    assert S.meets(overall, "F").first().meets and not S.meets(overall.withColumn("grade", overall.grade), "A+").first().meets


def test_filters_and_gate(spark, files, found):
    assert {r.category for r in api.scan(files, categories=("security",)).collect()} == {"security"}
    assert min(r.confidence for r in api.scan(files, min_confidence=0.75).collect()) >= 0.75
    assert S.gate(found, "high") and not S.gate(found.where("severity = 'low'"), "medium")
    # Repository detectors run on repositories under version control only.
    repos = {r.repo for r in api.repo_findings(files.withColumn("path", files.path), spark.createDataFrame([("s",)], "repo string")).collect()}
    assert repos <= {"s"}


def test_clean_and_transform_keep_files_without_content(files):
    done = api.transform(files)
    assert done.count() == files.count() and done.where("content is null and transformed is not null").count() == 0
    left = api.clean(files.where("path = 'a.rs' and repo = 'r'"))
    assert left.where("id like '%word%'").count() == 0
    both = api.transform(files, mode="independent")
    assert both.count() == files.count()


def test_calibration_and_baseline(spark, files, found, tmp_path):
    path = tmp_path / "out.toml"
    assert sinks.calibration(found, str(path), 0.3) == path.read_text() and 'minimum = "medium"' in path.read_text() and "0.3" in path.read_text()
    assert L.load(spark, str(tmp_path / "none")) is None and L.comment_threshold(None) == 0.45
    base = api.learn(corpus.from_table(spark.createDataFrame([("// a\nx = 1\n" * 10,)], "t string"), "'r'", "'a.rs'", "t"))
    L.save(base, str(tmp_path / "base"))
    assert L.comment_threshold(L.load(spark, str(tmp_path / "base"))) == pytest.approx(0.75)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT ink_lexical_terms('However robust') AS a, ink_lexical_terms(NULL) AS b, ink_prompt_markers('User: hi') AS c, ink_grade(12.0) AS d").first()
    assert tuple(row) == (2, 0, 1, "B+")
    spark.createDataFrame([("a robust plan\nin order to",), (None,)], "t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT m.recipe, m.kind, m.matched, m.line, m.replacement FROM texts, LATERAL ink_recipe_matches(t) m ORDER BY m.line").collect()
    assert [tuple(r) for r in got] == [("slop-vocabulary", "word", "robust", 1, "sturdy"), ("slop-vocabulary", "phrase", "in order to", 2, "to")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}\n")
    (tmp_path / "src/b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "files.txt").write_text("# list\nsrc/a.rs\nsrc/none.rs\nsrc/b.bin\n")
    files = corpus.directory(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/a.rs", "files.txt"}
    assert [r.path for r in corpus.listed(files, corpus.file_list(spark, str(tmp_path / "files.txt"))).collect()] == ["src/a.rs"]
    assert corpus.project_root(tmp_path / "src/a.rs") == tmp_path.resolve()
    assert corpus.allowed(tmp_path) and not corpus.allowed("/etc/passwd") and not corpus.allowed(tmp_path / ".ssh" / "id")
    assert language is not None
