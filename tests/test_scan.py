"""The scores over the whole scan against plain Python, and its findings against the detectors' own queries."""

import math
from collections import Counter

import pytest

from inkstrata.functions import vocabulary as V
from inkstrata.plans import catalogue as Q
from inkstrata.sources import overlay

SF = "/root/testdata/sf0.001"
FILE_DETECTORS = {"lexical": "lexical_findings", "comments": "comment_findings", "idiom": "idiom_findings", "prompt": "prompt_findings", "readme": "readme_findings"}
REPO_QUERIES = {"workflow": "repo_workflow", "metadata": "repo_metadata", "promotion": "repo_promotion", "maintenance": "repo_maintenance", "name_credibility": "repo_name", "commit_pattern": "commit_findings"}
WEIGHT, RAW = {"low": 0.2, "medium": 0.6, "high": 1.0}, {"low": 0.5, "medium": 1.5, "high": 3.0}


@pytest.fixture(scope="module")
def whole(spark):
    df = Q.whole(spark, SF)
    return df, df.collect()


def test_all_detectors_and_directives(spark, whole):
    found = whole[1]
    files = overlay.code_files(spark, SF).select("repo", "path", "content").collect()
    ignored = {(f.repo, f.path) for f in files if V.IGNORE_FILE in f.content}
    hushed = {(f.repo, f.path, i + 2) for f in files for i, x in enumerate(f.content.split("\n")) if V.IGNORE_NEXT in x}
    assert ignored and hushed
    assert not [r for r in found if r.line_start is not None and ((r.repo, r.path) in ignored or (r.repo, r.path, r.line_start) in hushed)]
    got = Counter((r.detector, r.repo, r.path) for r in found)
    for detector, name in FILE_DETECTORS.items():
        want = [(r.repo, r.path) for r in Q.QUERIES[name](spark, SF).collect()]
        assert {k[1:] for k in got if k[0] == detector} == set(want) - ignored, name
    for detector, name in REPO_QUERIES.items():
        assert sorted(r.repo for r in found if r.detector == detector) == sorted(r.repo for r in Q.QUERIES[name](spark, SF).collect()), name
    want = Counter((r.repo, r.path, r.id, r.line) for r in Q.QUERIES["suppress_next_line"](spark, SF).collect() if (r.repo, r.path) not in ignored)
    assert Counter((r.repo, r.path, r.id, r.line_start) for r in found if r.detector == "security") == want
    assert {"structure", "tests", "recipe"} <= {r.detector for r in found}


def test_scores(spark, whole):
    df, found = whole
    run = lambda name: Q.QUERIES[name](spark, SF, lambda *_: df).collect()
    weight = lambda r: WEIGHT[r.severity] * r.confidence
    levels = Counter(r.severity for r in found)
    s = run("summary")[0]
    assert (s.total, s.low, s.medium, s.high) == (len(found), levels["low"], levels["medium"], levels["high"])
    assert s.ai_probability == pytest.approx(1 / (1 + math.exp(-8 * (sum(map(weight, found)) / len(found) - 0.5))), abs=1e-4)
    n, raw, shares = Counter(), Counter(), Counter()
    for r in found:
        n[V.GRADE_OF[r.category]] += 1
        raw[V.GRADE_OF[r.category]] += RAW[r.severity] * r.confidence
        shares[r.category] += weight(r)
    grades = {r.grade_category: r for r in run("grade_categories")}
    assert len(grades) == 9 and all(grades[k].n == n[k] and grades[k].score == pytest.approx(min(100, 3.33 * raw[k]), abs=1e-2) for k in grades)
    assert all(n[k] for k in ("comments", "testing", "workflow", "history", "structure", "metadata"))
    some = {k: w for k, w in V.GRADE_WEIGHTS.items() if n[k]}
    assert run("grade_overall")[0].score == pytest.approx(sum(w * min(100, 3.33 * raw[k]) for k, w in some.items()) / sum(some.values()), abs=1e-2)
    assert {r.category: (r.n, r.contribution) for r in run("explain_categories")} == {k: (c, pytest.approx(shares[k], abs=1e-2)) for k, c in Counter(r.category for r in found).items()}
    assert [r.contribution for r in run("explain_top_evidence")] == pytest.approx(sorted(map(weight, found), reverse=True)[:5], abs=1e-3)
    want = Counter(f"inkstrata/{r.category}/{r.id}" for r in found)
    assert {r.rule: r.n for r in run("sarif_rules")} == want
    assert {r.severity: r.n for r in run("severity_filter")} == {k: v for k, v in levels.items() if k != "low"}
    assert {(r.repo, r.category, r.severity): r.n for r in run("findings_rollup") if r.repo and r.category and r.severity} == Counter((r.repo, r.category, r.severity) for r in found)
    assert len(run("annotations")) == len(found) + 1 and run("calibrate")[0].min_severity == "medium"
    segments = {(r.repo, r.path, r.category, (r.line_start - 1) // 80) for r in found if r.line_start is not None}
    assert len(run("mixed_dedup")) == len(segments) + sum(r.line_start is None for r in found)
