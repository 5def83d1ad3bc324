"""Rules that are tried on all lines at once: the same lines as the SQL's RE2 finds, whatever stands beside a match."""

import pytest

from inkstrata import api
from inkstrata.operators import files as D
from inkstrata.operators import rules as U
from inkstrata.operators import scores as S
from inkstrata.operators import transforms as X
from inkstrata.sources import corpus, sinks


def files(spark, *rows):
    made = [("r", path, path.split("/")[-1], path.rsplit(".", 1)[-1], len(text.encode()), text) for path, text in rows]
    return spark.createDataFrame(made, corpus.FILES)


def test_security_words_end_before_letters_that_are_not_ascii(spark):
    f = files(spark, ("a.go", "x\nUX!! DESÈOUME\nÉMD5"), ("b.rs", "DESOUME\n\u00a0DES\u00a0"), ("c.md", "DES"), ("e.py", ""))
    found = U.security_findings(D.prepared(f)).collect()
    assert sorted((r.path, r.id, r.line_start) for r in found) == [("a.go", "SEC004", 2), ("a.go", "SEC004", 3), ("b.rs", "SEC004", 2)]
    assert sorted(r.line_start for r in corpus.suppress(U.security_findings(D.prepared(f)), f).collect()) == [2, 2, 3]


def test_security_folds_like_the_sql(spark):
    # The long s and the Kelvin sign are folded, the dotless i is not; spaces are ASCII.
    f = files(spark, ("a.py", "veriıfy = False\npaſſword = 'hunter2secret'\nverify\u00a0= False\nverify = False"))
    assert sorted((r.id, r.line_start) for r in U.security_findings(D.prepared(f)).collect()) == [("SEC003", 2), ("SEC005", 4)]


def test_lexical_terms_of_many_files(spark):
    rows = [(f"f{i}.rs", "\n" * (i % 7) + ("However, this robust and seamless tool will leverage a realm." if i % 3 == 0 else "x")) for i in range(1500)]
    got = {r.path: (r.line_start, r.line_end) for r in D.lexical_findings(D.prepared(files(spark, *rows).coalesce(1))).collect()}
    assert got == {f"f{i}.rs": (i % 7 + 1, i % 7 + 1) for i in range(0, 1500, 3)}


def test_recipes_are_tried_on_files_of_any_size(spark):
    long = "x" * 99 + "\n"
    text = long * (3 << 20 >> 6) + "robust\n// Helper function to test\nThis is state-of-the-art"
    assert len(text) > 2 << 20
    found = U.recipe_findings(D.prepared(files(spark, ("a.md", text))), U.builtin()).collect()
    assert sorted(r.id for r in found) == ["comment-patterns:regex:helper-comment", "phrase-patterns:phrase:state-of-the-art", "slop-vocabulary:word:robust"]


def test_recipes_of_a_null_text(spark):
    f = files(spark, ("a.md", "robust")).selectExpr("repo", "path", "name", "ext", "size", "cast(null as string) as content")
    assert U.recipe_findings(D.prepared(f), U.builtin()).count() == 0


def _reads(spark, report):
    """How often a report makes the findings."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [("r", "p", f"i{k}", "lexical", "low", 0.5, k + 1, k + 1, k, None) for k in range(10)]
    schema = "repo string, path string, id string, category string, severity string, confidence double, line_start int, line_end int, ord long, suggestion string"
    found = spark.createDataFrame(rows, schema)
    report(found.mapInArrow(count, found.schema)).collect()
    return made.value


@pytest.mark.parametrize("report", [sinks.json_report, sinks.sarif_report, sinks.annotations, S.mixed])
def test_reports_make_their_findings_once(spark, report):
    assert _reads(spark, report) == 10


def test_grade_report_makes_its_findings_once(spark):
    assert _reads(spark, lambda found: sinks.grade_report(spark, found)) == 10


def test_replacement_reads_lines_that_may_match(spark):
    text = "We utilize it\r\nUTİLİZE, utılize\nrobust_x\n\nthus.\nin order to go\n"
    r = X.replace_recipes(files(spark, ("a.md", text), ("b.md", "x  y \n"))).orderBy("path").collect()
    # The dotless i is folded by the expression for words, but names nothing in the table.
    assert r[0].replaced == "We use it\nUTİLİZE, utılize\nrobust_x\n\nso.\nto go" and r[0].replacements == 3
    assert r[1].replaced == "x  y \n" and r[1].replacements == 0


def test_scan_tests_its_lines_in_one_pass(spark):
    plan = api.file_findings(files(spark, ("a.rs", "x")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_markers_and_shapes_where_lines_may_hold_them(spark):
    text = " fn été() {\n}\ntry:\nself.x\nclass A\nUser: x\nprompt: y"
    p = D.add_all(D.prepared(files(spark, ("a.rs", text), ("b.rs", "plain"))))
    got = [(r.function_count, r.foreign, r.native, r.prompts, r.test_count) for r in p.orderBy("path").collect()]
    assert got == [(1, 3, 0, 2, 0), (0, 0, 0, 0, 0)]
