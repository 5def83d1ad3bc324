"""Detectors, rules and transforms on small inputs, each with what should and should not be found."""

import pytest
from pyspark.sql import functions as F

from inkstrata.functions.text import DEAD_TERMS, lines
from inkstrata.operators import files as D
from inkstrata.operators import history as H
from inkstrata.operators import rules as U
from inkstrata.operators import scores as S
from inkstrata.operators import transforms as X
from inkstrata.sources import corpus


def files(spark, *rows):
    made = [("r", path, path.split("/")[-1], path.rsplit(".", 1)[-1], len(text.encode()), text) for path, text in rows]
    return spark.createDataFrame(made, corpus.FILES)


def test_lines(spark):
    rows = spark.createDataFrame([("a\r\nb\n",), ("",), ("a\n\n",), ("x",)], "t string").select(lines(F.col("t")).alias("l")).collect()
    assert [r.l for r in rows] == [["a", "b"], [], ["a", ""], ["x"]]


def test_dead_terms():
    assert sorted(DEAD_TERMS) == ["provides a streamlined", "seamless integration", "this underscores the importance of"]


def test_lexical_terms_match_inside_words(spark):
    p = D.prepared(files(spark, ("a.rs", "Enthusiasm for a comprehensive seamless integration")))
    r = D.lexical(p).first()
    assert r.found == ["thus", "a comprehensive", "seamless"] and r.matches == 3 and r.terms == 3
    assert D.lexical_findings(p).count() == 0


def test_structure_nested_and_unclosed(spark):
    text = "/// Doc.\npub fn a() {\n  fn inner() { }\n}\npub fn b() {\n  x\n"
    r = D.structure(D.prepared(files(spark, ("a.rs", text)))).first()
    assert r.function_count == 2 and r.doc_coverage == 0.5 and r.pub_fraction == 1.0


def test_structure_python(spark):
    r = D.structure(D.prepared(files(spark, ("a.py", "def a():\n    x\n\n    y\nz\ndef b():\n    x\n")))).first()
    assert r.function_count == 2 and r.length_cv == pytest.approx(1 / 3)


@pytest.mark.parametrize("ext,line,rule", [("py", "x = pickle.loads(b)", "SEC012"), ("rs", 'password = "hunter2secret"', "SEC003"), ("ts", "eval(userInput)", "SEC002"), ("py", "requests.get(url, verify=False)", "SEC005")])
def test_security(spark, ext, line, rule):
    found = lambda name, text: {r.id for r in U.security_findings(D.prepared(files(spark, (name, text)))).collect()}
    assert rule in found(f"a.{ext}", line)
    assert found(f"vendor/a.{ext}", line) == set() and found("a.md", line) == set() and found(f"a.{ext}", "let x = 1") == set()


def test_suppressed(spark):
    f = files(spark, ("a.py", f"# {corpus.V.IGNORE_NEXT}\nx = pickle.loads(b)\nx = pickle.loads(b)"))
    assert [r.line_start for r in corpus.suppress(U.security_findings(D.prepared(f)), f).collect()] == [3]


def test_words_have_boundaries(spark):
    f = D.prepared(files(spark, ("a.md", "robust_x and robusté, Robust x_robust")))
    found = U.recipe_findings(f, U.select(U.builtin(), ("slop-vocabulary",)))
    assert [r.matched for r in found.collect()] == ["robust", "robust"]


def test_boost_on_bucket_edge(spark):
    text = "\n".join("robust" if i in (1, 2, 3, 15) else "robust" if i == 16 else "x" for i in range(1, 20))
    recipes = U.select(U.builtin(), ("slop-vocabulary",))
    got = {r.line_start: r.boosted for r in U.boosted(U.recipe_findings(D.prepared(files(spark, ("a.md", text))), recipes), recipes).collect()}
    assert got == {1: True, 2: True, 3: True, 15: True, 16: False}


def test_thinning(spark):
    f = files(spark, ("a.rs", "// Returns x.\n// alpha beta gamma one\n// alpha beta gamma two\n// why: alpha beta\ncode\n"))
    r = X.thin_comments(f).first()
    assert r.thinned == "// alpha beta gamma one\n// why: alpha beta\ncode\n" and r.removed_comments == 2


def test_replacement_normalises(spark):
    r = X.replace_recipes(files(spark, ("a.md", "  We utilize  it , thus .\n"))).first()
    assert r.replaced == " We use it, so." and r.replacements == 2


def test_readme(spark):
    r = X.clean_readme(files(spark, ("a.md", "# T\n\n## FAQ\n\n\n## Usage\nx\nMade with love\n"))).first()
    assert r.cleaned == "# T\n\n## Usage\nx\n" and r.removed_lines == 2


def test_sessions_and_groups(spark):
    c = spark.createDataFrame([("r", "1", 0, ["a", "b"]), ("r", "2", 600, ["b", "c"]), ("r", "3", 700, ["z"]), ("r", "4", 1301, ["z"])], "repo string, oid string, ts long, files array<string>")
    assert [r.session for r in H.sessions(c).orderBy("ts").collect()] == [0, 0, 0, 1]
    assert [r.oids for r in H.overlap_groups(c).orderBy("session", "grp").collect()] == [["1", "2"], ["3"], ["4"]]


def test_grade_of_nothing(spark):
    none = spark.createDataFrame([], "repo string, path string, id string, category string, severity string, confidence double, line_start int, ord long")
    assert S.summary(none).first().ai_probability == 0 and S.overall_grade(spark, none).first().grade == "A+" and S.category_grades(spark, none).count() == 9


def test_mixed_keeps_the_first_of_equals(spark):
    row = lambda ord_, line: ("r", "p", f"i{ord_}", "lexical", "low", 0.5, line, ord_)
    f = spark.createDataFrame([row(2, 5), row(1, 6), row(3, 90)], "repo string, path string, id string, category string, severity string, confidence double, line_start int, ord long")
    assert sorted(r.ord for r in S.mixed(f).collect()) == [1, 3]


def test_ignore_rules(spark):
    f = files(spark, ("target/a.rs", ""), ("src/b.rs", ""), ("src/keep.log", ""), ("x.log", ""))
    assert sorted(r.path for r in corpus.prune(f, ["target/", "*.log", "!keep.log"]).collect()) == ["src/b.rs", "src/keep.log"]


def test_windows():
    with pytest.raises(ValueError):
        U.Recipe("x", "lexical", confidence=1.5)


def test_stream(spark, tmp_path):
    from inkstrata.streaming import scan

    source = tmp_path / "in"
    files(spark, ("a.rs", "However, this robust and seamless tool will leverage a realm.")).write.parquet(str(source))
    scan.write(scan.findings(scan.read(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["lexical.cluster"]
