"""Commands over a small repository, and streams."""

import json
import subprocess
import time

import pytest

from inkstrata.__main__ import main
from inkstrata.sources import corpus
from inkstrata.streaming import scan as stream

SLOP = "// This function is a helper.\n// However, this robust and seamless tool will leverage a comprehensive realm.\nfn a() {}\n// Thus we delve into the landscape; moreover it is pivotal.\n"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("work") / "demo"
    (at / "src").mkdir(parents=True)
    (at / "src/a.rs").write_text(SLOP)
    (at / "src/b.rs").write_text("fn b() {}\n")
    (at / "src/gen.rs").write_text(SLOP)
    (at / ".inkstrataignore").write_text("gen.rs\n")
    (at / ".inkstrata/recipes").mkdir(parents=True)
    (at / ".inkstrata/recipes/own.toml").write_text('[recipe]\nname = "own"\n[patterns.words]\nitems = [{ word = "demo-word", replacement = "x", severity = "high" }]\n')
    (at / ".inkstrata/recipes/bad.toml").write_text("[recipe\n")
    for args in (["init", "-q", "-b", "main"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-q", "-m", "feat: one"]):
        subprocess.run(["git", "-C", str(at), *args], check=True)
    return at


def run(capsys, *args):
    with pytest.warns(UserWarning, match="bad.toml") if args[0] not in ("learn", "status", "plan") else pytest.MonkeyPatch.context():
        code = main([args[0], *map(str, args[1:])])
    return code, capsys.readouterr().out


def test_scan(spark, repo, capsys):
    code, out = run(capsys, "scan", repo, "--format", "json", "--explain", "--fail-on", "high")
    report = json.loads(out)
    assert code == 1 and {f["path"] for f in report["findings"] if f["path"].startswith("src/")} == {"src/a.rs"} and report["summary"]["high"] > 0
    code, out = run(capsys, "scan", repo, "--exclude", "slop-vocabulary", "--exclude", "phrase-patterns", "--category", "lexical")
    assert code == 0 and "lexical.cluster" in out and ":word:" not in out
    assert json.loads(run(capsys, "scan", repo, "--format", "sarif")[1])["version"] == "2.1.0"
    assert run(capsys, "recipes", repo)[1].count("\n") == 4 and "own\trepository" in run(capsys, "recipes", repo)[1]


def test_other_commands(spark, repo, capsys, tmp_path):
    code, out = run(capsys, "grade", repo, "--min-grade", "A+")
    assert code in (0, 1) and "overall" in out
    assert "replaced" in run(capsys, "transform", repo, "--out", tmp_path / "t")[1]
    assert {r.path for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"src/a.rs"}
    assert main(["learn", str(repo)]) == 0 and (repo / ".inkstrata/baseline").exists()
    assert "min_severity" in run(capsys, "calibrate", repo, "--apply", tmp_path / "c.toml")[1] and (tmp_path / "c.toml").exists()
    spark.createDataFrame([("src/a.rs", True), ("src/b.rs", False)], "path string, expected boolean").write.parquet(str(tmp_path / "labels"))
    assert json.loads(run(capsys, "eval", repo, "--labels", tmp_path / "labels")[1])["accuracy"] == 1.0
    assert json.loads(run(capsys, "plan", repo, "--now", 0)[1])["target"] == 3600
    assert json.loads(run(capsys, "status", repo)[1])["pending"] == 1


def test_streams(spark, tmp_path):
    rows = [("r", f"f{k}.rs", f"f{k}.rs", "rs", len(SLOP), SLOP) for k in range(4)] + [("r", "g.rs", "g.rs", "rs", 0, None)]
    spark.createDataFrame(rows, corpus.FILES).repartition(2).write.parquet(str(tmp_path / "in"))
    stream.write_batches(stream.read(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("id like '%:word:robust'").count() == 4 and {r.path for r in got.collect()} == {f"f{k}.rs" for k in range(4)}
    commits = spark.createDataFrame([("r", 0), ("r", 60), ("r", 4000), ("q", 10)], "repo string, s long").selectExpr("repo", "timestamp_seconds(s) AS at")
    commits.write.parquet(str(tmp_path / "commits"))
    live = stream.sessions(spark.readStream.schema(commits.schema).parquet(str(tmp_path / "commits")))
    live.writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.repo, r.commits) for r in spark.table("sess").collect()) == [("q", 1), ("r", 1), ("r", 2)]
    seen = []
    plan = spark.createDataFrame([("a", 10, False), ("b", 10, True), ("c", 4_000_000_000, False)], "oid string, target long, completed boolean")
    query = stream.tick(spark.readStream.format("rate").load(), plan, lambda due, now: seen.append(sorted(r.oid for r in due.collect())), str(tmp_path / "c2"), every="1 second")
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    query.stop()
    assert seen[0] == ["a"]
