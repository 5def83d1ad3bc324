"""Git ingestion, pending commits, sessions, groups, schedules and plans."""

import random
import subprocess
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkstrata.operators import history as H
from inkstrata.sources import git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    run = lambda *a, **k: subprocess.run(["git", "-c", "user.name=A B", "-c", "user.email=a@b.c", "-C", str(at), *a], check=True, capture_output=True, **k)
    run("init", "-q", "-b", "main")
    for k in range(7):
        (at / f"f{k % 3}.txt").write_text(f"{k}\n")
        run("add", ".")
        day = f"2024-01-0{k + 1}T10:00:00+0200"
        run("commit", "-q", "-m", f"feat: change {k}\n\nbody \u00e9", env={"GIT_AUTHOR_DATE": day, "GIT_COMMITTER_DATE": day, "PATH": "/usr/bin:/bin"})
    run("checkout", "-q", "-b", "side", "HEAD~2")
    (at / "side.txt").write_text("s")
    run("add", ".")
    day = "2024-01-09T10:00:00+0200"
    run("commit", "-q", "-m", "side", env={"GIT_AUTHOR_DATE": day, "GIT_COMMITTER_DATE": day, "PATH": "/usr/bin:/bin"})
    run("checkout", "-q", "main")
    day = "2024-01-10T10:00:00+0200"
    run("merge", "-q", "--no-ff", "-m", "merge", "side", env={"GIT_AUTHOR_DATE": day, "GIT_COMMITTER_DATE": day, "PATH": "/usr/bin:/bin"})
    return str(at)


def test_log(spark, repo, tmp_path):
    rows = git.commits(spark, repo, repo="x", per_partition=2).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(9)) and rows[0].message == "merge" and rows[0].files == ["side.txt"]
    assert rows[-1].message == "feat: change 0\n\nbody \u00e9" and rows[-1].files == ["f0.txt"] and {r.tz_offset_min for r in rows} == {120} and rows[-1].ts == 1704096000
    assert {r.author for r in rows} == {"A B"} and {r.repo for r in rows} == {"x"}
    left = H.pending(git.commits(spark, repo, repo="x"), rows[2].oid).collect()
    assert [r.oid for r in left] == [rows[1].oid, rows[0].oid]
    assert H.pending(git.commits(spark, repo)).count() == 9
    assert [r.repo for r in git.repositories(spark, {"x": repo, "y": str(tmp_path)}).collect()] == ["x"]
    (tmp_path / "n").mkdir()
    subprocess.run(["git", "init", "-q", str(tmp_path / "n")], check=True)
    assert git.commits(spark, str(tmp_path / "n")).count() == 0
    with pytest.raises(Exception, match="git"):
        git.commits(spark, "/nowhere").count()


def random_commits(n=400):
    r = random.Random(3)
    out, at = [], defaultdict(int)
    for k in range(n):
        repo = r.choice("aaaab")
        at[repo] += r.choice([0, 5, 100, 600, 601, 5000])
        out.append((repo, at[repo], f"{k:04d}", [f"d{r.randrange(4)}/f{r.randrange(6)}" for _ in range(r.randrange(0, 3))], f"m{k}"))
    return out


def test_sessions_and_groups(spark):
    rows = random_commits()
    df = spark.createDataFrame(rows, "repo string, ts long, oid string, files array<string>, message string")
    want, groups = {}, {}
    for repo in "ab":
        session, last, grp, seen = 0, None, 0, None
        for _, ts, oid, files, _ in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[1], r[2])):
            new = last is not None and ts - last > 600
            session, last = session + new, ts
            want[oid] = session
            if new or seen is None:
                grp, seen = 0, set(files)
            elif seen & set(files):
                seen |= set(files)
            else:
                grp, seen = grp + 1, set(files)
            groups.setdefault((repo, session, grp), []).append(oid)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert {r.oid: r.session for r in H.sessions(df).collect()} == want
    got = H.overlap_groups(df)
    assert {(r.repo, r.session, r.grp): r.oids for r in got.collect()} == groups
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    messages = H.plan_commits(got, df).collect()
    assert all(m.messages == [f"m{int(o)}" for o in m.oids] for m in messages) and len(messages) == len(groups)
    assert H.sessions(df.limit(0)).count() == 0 and H.overlap_groups(df.limit(0)).count() == 0


def plain_next(at, windows):
    if not windows:
        return at + 3600
    for moment in range(at // 60, at // 60 + 3000):
        minute = moment % 1440
        if any(a <= minute < b if b > a else minute >= a or minute < b for a, b in windows):
            return at if moment == at // 60 else moment * 60
    raise AssertionError


@pytest.mark.parametrize("windows", [[], ["09:00-12:30", "13:00-17:00"], ["22:00-02:00"], ["bad", "08:15-08:16"]])
@pytest.mark.parametrize("per_session, variance", [(5, 0.25), (7, 0.0), (1, 1.0)])
def test_schedule(spark, windows, per_session, variance):
    now, n = 1704067200 + 8 * 3600 + 17, 90
    groups = spark.range(n).select(F.lit("r").alias("repo"), F.lit(0).alias("session"), F.col("id").cast("int").alias("grp"))
    each = 120 // per_session
    step = (each + max(1, round(variance * each + 1e-9))) * 60
    parsed = H.parsed_windows(windows)
    want = [plain_next(now, parsed)]
    while len(want) < n:
        want.append(plain_next(want[-1] + step, parsed))
    got = [r.target for r in H.schedule(groups, now, per_session, variance, windows).orderBy("grp").collect()]
    assert got == want
    if windows == [] and (per_session, variance) == (5, 0.25):
        assert [t - now for t in got[:3]] == [3600, 9000, 14400]


def test_windows(spark):
    moments = spark.range(0, 86400 * 2, 977).withColumn("at", F.col("id") + 1704067200)
    for windows in (["09:00-12:30", "22:00-02:00"], ["00:00-00:00"], []):
        got = moments.select("at", H.next_active(F.col("at"), windows).alias("n")).collect()
        assert all(r.n == plain_next(r.at, H.parsed_windows(windows)) == H.next_active_seconds(r.at, windows) for r in got)
    assert H.validate_schedule(5, 0.2, ["09:00-17:00"]) == [] and len(H.validate_schedule(0, 2.0, ["25:00-01:00"])) == 3
