"""File detectors: one pass of array expressions gives all metrics of a file, without a shuffle.

Each `add_...` puts a detector's metrics beside a file, each `..._flags` turns them into findings or nulls, and `emit` lists
the findings. A detector's own query and the scan of all detectors are made of the same parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.matching import LineTest, matching, wider
from ..functions.text import LEXICAL_REGEX, any_of, any_regex, ascii_lower, comment_body, first_words, hits, is_comment, language, let, lines, mode_count, once, starts_with_any, trim

#: Columns of a finding.
FINDING = ("repo", "path", "detector", "id", "category", "severity", "confidence", "line_start", "line_end", "ord", "suggestion")
#: What a finding says of itself besides; recipe matches await their id and severity.
FLAG = "struct<detector:string,id:string,category:string,severity:string,confidence:double,line_start:int,line_end:int,ord:bigint,recipe:string,kind:string,key:string>"
#: Lines that may hold a lexical term: folding takes more letters than A-Z for those of the terms.
LEXICAL_TESTS = (LineTest("terms", LEXICAL_REGEX, True, tuple(e for es in V.LANGUAGES.values() for e in es)),)
SECURITY_TESTS = tuple(LineTest(id_, pattern, fold, extensions or V.SECURITY_EXTENSIONS) for id_, _, _, extensions, fold, pattern in V.SECURITY)
FUNCTION_TESTS = tuple(LineTest(n, wider(p), False, V.LANGUAGES[n]) for n, p in V.FUNCTION_PATTERNS.items())
SHAPE_TESTS = tuple(LineTest(n, wider(p), False, V.LANGUAGES[n]) for n, (p, *_) in V.TEST_SHAPES.items())
PROMPT_EXTENSIONS = ("md", "txt", "rst", "adoc", "rs", "py", "go", "ts", "tsx", "js", "jsx", "cs", "zig", "cpp", "toml", "yaml", "json")
#: Lines that may hold a marker, or the beginning of one that holds a line end.
MARKER_TESTS = (LineTest("idiom", any_regex(m.split("\n")[0] for m in V.FOREIGN + V.NATIVE), True, ("rs",)), LineTest("prompt", any_regex(V.PROMPT), True, PROMPT_EXTENSIONS))
README_TESTS = (LineTest("phrases", any_regex(V.README_PHRASES), True, ("md",)),)


def known() -> Column:
    return F.col("lang") != "unknown"


def prepared(files: DataFrame) -> DataFrame:
    """Adds the lines, trimmed lines and language that the detectors share; each is made once.

    Also the lines on which the detectors' patterns may match, for detectors that use them; others do not pay for them.
    """
    f = files.select("repo", "path", "name", "ext", "size", "content").withColumn("lang", language(F.col("ext")))
    f = once(f, lines=lines(F.col("content")))
    f = once(f, trimmed=F.transform("lines", trim), n_lines=F.greatest(F.lit(1), F.size("lines")))
    for name, tests in (("lexical_at", LEXICAL_TESTS), ("security_at", SECURITY_TESTS), ("function_at", FUNCTION_TESTS), ("test_at", SHAPE_TESTS), ("marker_at", MARKER_TESTS), ("readme_at", README_TESTS)):
        f = f.withColumn(name, matching(tests))
    return f


def some(at: str, tests: tuple[LineTest, ...]) -> Column:
    """Whether any of the tests has a line."""
    return reduce(lambda a, b: a | b, (F.size(F.col(at)[t.name]) > 0 for t in tests))


def where_in_lines(array: Column, test: Callable[[Column], Column]) -> Column:
    """1-based numbers of the elements that pass."""
    return F.filter(F.transform(array, lambda x, i: F.when(test(x), i + 1)), lambda x: x.isNotNull())


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def add_lexical(p: DataFrame) -> DataFrame:
    # No term holds a line end, so the matches of the lines are those of the text.
    terms = lambda i: F.regexp_extract_all(ascii_lower(F.get("lines", i - 1)), F.lit(LEXICAL_REGEX), F.lit(0))
    p = once(p, per_line=F.filter(F.transform("lexical_at.terms", lambda i: F.struct(i.alias("no"), terms(i).alias("found"))), lambda r: F.size(r["found"]) > 0))
    p = once(p, found=F.flatten("per_line.found"))
    return once(p, matches=F.size("found"), terms=F.size(F.array_distinct("found")), first_line=F.array_min("per_line.no"), last_line=F.array_max("per_line.no")).drop("per_line", "found")


def lexical(p: DataFrame) -> DataFrame:
    return add_lexical(p.where(known()))


def add_comments(p: DataFrame) -> DataFrame:
    p = once(p, own=F.when(known(), F.filter(F.transform("trimmed", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("no"))), lambda r: is_comment(r["x"]))).otherwise(F.array().cast("array<struct<x:string,no:int>>")))
    starts = F.filter(F.transform("own", lambda r: first_words(comment_body(r["x"]), 3)), lambda x: x != "")
    p = once(
        p, non_empty=F.size(F.filter("trimmed", lambda x: x != "")), comment_lines=F.size("own"), tutorial=F.size(F.filter("own", lambda r: any_of(ascii_lower(r["x"]), V.TUTORIAL))),
        first_comment=F.get("own", F.lit(0))["no"], last_comment=F.get("own", F.size("own") - 1)["no"], most=mode_count(starts),
    )
    return once(p, density=ratio(F.col("comment_lines"), F.col("non_empty")), comment_prefix_ratio=ratio(F.col("most"), F.col("comment_lines"))).drop("own", "most")


def comments(p: DataFrame) -> DataFrame:
    return add_comments(p.where(known())).withColumnRenamed("comment_prefix_ratio", "prefix_ratio")


def headings(trimmed: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(trimmed, lambda x: F.startswith(x, F.lit("#"))), lambda x: ascii_lower(trim(F.regexp_replace(x, "^#+", "")))))


def add_readme(p: DataFrame) -> DataFrame:
    wanted, md = F.array(*map(F.lit, V.README_HEADINGS)), F.col("ext") == "md"
    return once(p, sections=F.when(md, F.size(F.array_intersect(headings(F.col("trimmed")), wanted))), phrases=F.when(md, F.when(some("readme_at", README_TESTS), hits(ascii_lower(F.col("content")), V.README_PHRASES)).otherwise(0)))


def by_language(make: Callable[[str], Column], names) -> Column:
    return reduce(lambda out, name: F.when(F.col("lang") == name, make(name)).otherwise(out), names, F.lit(None))


def add_test_shape(p: DataFrame) -> DataFrame:
    def names(lang: str) -> Column:
        pattern, start, _, _ = V.TEST_SHAPES[lang]
        got = F.transform(F.col("trimmed"), lambda x: F.regexp_extract(x, pattern, 1))
        return F.filter(got, lambda x: (x != "") & F.startswith(x, F.lit(start)))

    def asserts(lang: str) -> Column:
        _, _, inside, start = V.TEST_SHAPES[lang]
        return F.size(F.filter("trimmed", lambda x: any_of(x, inside) | starts_with_any(x, start) if start else any_of(x, inside)))

    # Without tests the assertions do not matter.
    here = some("test_at", SHAPE_TESTS)
    p = once(p, tests=F.when(here, by_language(names, V.TEST_SHAPES)).when(known(), F.array().cast("array<string>")), asserts=F.when(here, by_language(asserts, V.TEST_SHAPES)).when(known(), F.lit(0)))
    p = once(p, test_count=F.size("tests"), same_start=mode_count(F.transform("tests", lambda x: F.substring_index(x, "_", 2))))
    return once(p, test_prefix_ratio=ratio(F.col("same_start"), F.col("test_count")), assert_density=ratio(F.col("asserts"), F.col("test_count"))).drop("tests", "same_start")


def test_shape(p: DataFrame) -> DataFrame:
    return add_test_shape(p.where(known())).withColumnRenamed("test_prefix_ratio", "prefix_ratio")


def braces(line: Column) -> Column:
    """What the braces of a line add to the depth, whether any opens, and by how much the depth differs where one closes:
    anywhere, and after one of the line's own. The sets of differences stay small."""
    start = F.expr("named_struct('total', 0, 'opens', false, 'closed', array_repeat(0, 0), 'own', array_repeat(0, 0))")

    def one(a: Column, c: Column) -> Column:
        now, opens = a["total"] + F.when(c == "{", 1).otherwise(-1), c == "{"
        add = lambda known, test: F.when(test & ~F.array_contains(known, now), F.array_append(known, now)).otherwise(known)
        return F.struct(now.alias("total"), (a["opens"] | opens).alias("opens"), add(a["closed"], ~opens).alias("closed"), add(a["own"], ~opens & a["opens"]).alias("own"))

    return F.aggregate(F.regexp_extract_all(line, F.lit("[{}]"), F.lit(0)), start, one)


def add_structure(p: DataFrame) -> DataFrame:
    """Function lengths, documentation and visibility, by one fold over the lines of each language whose state keeps its size."""
    here = some("function_at", FUNCTION_TESTS)
    p = once(
        p,
        is_fn=F.when(here, by_language(lambda n: F.transform("lines", lambda x: F.regexp_like(x, F.lit("(?U)" + V.FUNCTION_PATTERNS[n]))), V.FUNCTION_PATTERNS)),
        is_doc=F.when(here, by_language(lambda n: F.transform("lines", lambda x: F.regexp_like(x, F.lit("(?U)" + V.DOC_PATTERNS[n]))), V.DOC_PATTERNS)),
    )
    stripped = lambda x: F.regexp_replace(x, r"(?U)^\s+", "")
    pub = lambda n: F.transform("lines", lambda x: F.startswith(stripped(x), F.lit(V.PUBLIC_STARTS[n])) if n in V.PUBLIC_STARTS else F.lit(True))
    # Files without a function need no fold.
    p = once(p, is_pub=F.when(F.exists("is_fn", lambda x: x), by_language(pub, V.FUNCTION_PATTERNS)))
    # Per line: indent (null if blank), whether it may belong to a look-back run, and what its braces do.
    run = lambda x: F.when(F.col("lang") == "python", F.startswith(trim(x), F.lit('"""'))).otherwise(F.startswith(trim(x), F.lit("//"))) | starts_with_any(trim(x), ("#", "*", "/*")) | (trim(x) == "")
    row = lambda x, i: F.struct(
        i.alias("i"), let(trim(x), lambda t: F.when(t == "", F.lit(None)).otherwise(F.length(x) - F.length(stripped(x)))).alias("indent"), run(x).alias("run"),
        F.get("is_fn", i).alias("fn"), F.get("is_doc", i).alias("doc"), F.get("is_pub", i).alias("pub"), braces(x).alias("b"),
    )
    p = once(p, rows=F.when(F.col("is_pub").isNotNull(), F.transform("lines", row)))
    start = F.expr("named_struct('open', false, 'begin', 0, 'last', 0, 'depth', 0, 'seen', false, 'indent', 0, 'doc', false, 'pub', false, 'behind', false, 'n', 0, 'sum', 0L, 'squares', 0L, 'docs', 0, 'pubs', 0)")

    def step(a: Column, r: Column) -> Column:
        python, b = F.col("lang") == "python", r["b"]
        ended = python & a["open"] & r["indent"].isNotNull() & (r["indent"] <= a["indent"])

        def after(t: Column) -> Column:
            was, new = t["was"], t["new"]
            begin, doc, pub = F.when(new, r["i"]).otherwise(a["begin"]), F.when(new, a["behind"]).otherwise(a["doc"]), F.when(new, r["pub"]).otherwise(a["pub"])
            # The function that the line ends from outside, and that whose last brace it closes.
            outer, inner = (a["last"] - a["begin"] + 1).cast("long"), (r["i"] - begin + 1).cast("long")
            add = lambda x, y: F.when(t["ended"], x).otherwise(0) + F.when(t["done"], y).otherwise(0)
            return F.struct(
                ((was | new) & ~t["done"]).alias("open"), begin.alias("begin"), F.when(new | (was & ~(python & r["indent"].isNull())), r["i"]).otherwise(a["last"]).alias("last"),
                F.when(new, b["total"]).when(was, a["depth"] + b["total"]).otherwise(a["depth"]).alias("depth"), F.when(new, b["opens"]).when(was, a["seen"] | b["opens"]).otherwise(a["seen"]).alias("seen"),
                F.when(new, F.coalesce(r["indent"], F.lit(0))).otherwise(a["indent"]).alias("indent"), doc.alias("doc"), pub.alias("pub"),
                # A look-back run: whether the lines right before the next one hold documentation.
                F.when(r["run"], a["behind"] | r["doc"]).otherwise(F.lit(False)).alias("behind"),
                (a["n"] + add(F.lit(1), F.lit(1))).alias("n"), (a["sum"] + add(outer, inner)).alias("sum"), (a["squares"] + add(outer * outer, inner * inner)).alias("squares"),
                (a["docs"] + add(a["doc"].cast("int"), doc.cast("int"))).alias("docs"), (a["pubs"] + add(a["pub"].cast("int"), pub.cast("int"))).alias("pubs"),
            )

        was = a["open"] & ~ended
        state = F.struct(ended.alias("ended"), was.alias("was"), (~was & r["fn"]).alias("new"))
        # The first return to depth 0 after a brace was opened ends a function.
        done = lambda t: ~python & F.when(t["was"], F.array_contains(F.when(a["seen"], b["closed"]).otherwise(b["own"]), -a["depth"])).otherwise(t["new"] & F.array_contains(b["own"], 0))
        return let(state, lambda t: let(F.struct(t["ended"].alias("ended"), t["was"].alias("was"), t["new"].alias("new"), done(t).alias("done")), after))

    def finish(a: Column) -> Column:
        size, more = (a["last"] - a["begin"] + 1).cast("long"), a["open"].cast("int")
        return F.struct((a["n"] + more).alias("n"), (a["sum"] + more * size).alias("sum"), (a["squares"] + more * size * size).alias("squares"), (a["docs"] + more * a["doc"].cast("int")).alias("docs"), (a["pubs"] + more * a["pub"].cast("int")).alias("pubs"))

    p = once(p, fold=F.aggregate("rows", start, step, finish)).drop("is_fn", "is_doc", "is_pub", "rows")
    f, n = F.col("fold"), F.coalesce(F.col("fold.n"), F.lit(0))
    # Deviation over mean, from exact sums.
    cv = F.when((n < 2) | (f["sum"] == 0), F.lit(0.0)).otherwise(F.sqrt((n * f["squares"] - f["sum"] * f["sum"]).cast("double")) / f["sum"])
    return once(p, function_count=n, length_cv=F.coalesce(cv, F.lit(0.0)), doc_coverage=F.coalesce(ratio(f["docs"], n), F.lit(0.0)), pub_fraction=F.coalesce(ratio(f["pubs"], n), F.lit(0.0))).drop("fold")


def structure(p: DataFrame) -> DataFrame:
    return add_structure(p.where(known())).select("repo", "path", "lang", "n_lines", "function_count", "length_cv", "doc_coverage", "pub_fraction")


def flag(test: Column, order: int, detector: str, id_: str, category: str, high: Column, confidence: Column, start=None, end=None) -> Column:
    """A finding where the test holds, else null."""
    none = F.lit(None).cast("string")
    return F.when(test, F.struct(
        F.lit(detector).alias("detector"), F.lit(id_).alias("id"), F.lit(category).alias("category"), F.when(high, "high").otherwise("medium").alias("severity"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence.cast("double"))).alias("confidence"), (F.lit(1) if start is None else start).cast("int").alias("line_start"), (F.col("n_lines") if end is None else end).cast("int").alias("line_end"),
        F.lit(order * 10**12).cast("long").alias("ord"), none.alias("recipe"), none.alias("kind"), none.alias("key"),
    )).cast(FLAG)


def emit(p: DataFrame, *flags: Column, more: Column | None = None) -> DataFrame:
    """The findings of each file as rows."""
    found = F.filter(F.array(*flags), lambda f: f.isNotNull()) if flags else F.array().cast(f"array<{FLAG}>")
    rows = p.select("repo", "path", F.inline(found if more is None else F.concat(found, more)), F.lit(None).cast("string").alias("suggestion"))
    return rows if more is not None else rows.select(*FINDING)


C = F.col


def lexical_flag() -> Column:
    return flag(known() & (C("matches") >= 4) & (C("terms") >= 3), 1, "lexical", "lexical.cluster", "lexical", C("matches") >= 8, C("matches") / 12 + C("terms") / 12, C("first_line"), C("last_line"))


def comment_flag(threshold: float) -> Column:
    test = known() & (C("non_empty") >= 12) & (C("density") >= threshold) & ((C("tutorial") >= 3) | (C("comment_prefix_ratio") >= 0.65))
    return flag(test, 2, "comments", "comments.over_documented", "comment", (C("density") > 0.60) & (C("tutorial") > 3), 0.5 * C("density") + 0.3 * C("tutorial") / 8 + 0.2 * C("comment_prefix_ratio"), C("first_comment"), C("last_comment"))


def structure_flag() -> Column:
    signals = (C("length_cv") < 0.25).cast("int") + (C("doc_coverage") >= 0.88).cast("int") + (C("pub_fraction") >= 0.93).cast("int")
    return flag(known() & (C("function_count") >= 5) & (signals >= 2), 3, "structure", "structure.uniform", "structure", (signals == 3) | (C("length_cv") < 0.10), 0.9 * (0.5 * (1 - C("length_cv")) + 0.3 * C("doc_coverage")))


def test_flag() -> Column:
    test = known() & (C("test_count") >= 6) & (C("test_prefix_ratio") >= 0.65) & (C("assert_density") >= 0.5)
    return flag(test, 4, "tests", "tests.symmetric.shape", "test_pattern", (C("test_prefix_ratio") > 0.80) & (C("assert_density") > 0.70), 0.6 * C("test_prefix_ratio") + 0.4 * C("assert_density"))


def add_markers(p: DataFrame) -> DataFrame:
    rust = C("ext") == "rs"
    # Without a line that may hold a marker there is none.
    p = once(p, lc=F.when(some("marker_at", MARKER_TESTS), ascii_lower(C("content"))).otherwise(F.lit("")))
    return once(p, foreign=F.when(rust, hits(C("lc"), V.FOREIGN)), native=F.when(rust, hits(C("lc"), V.NATIVE)), prompts=F.when(C("ext").isin(*PROMPT_EXTENSIONS), hits(C("lc"), V.PROMPT))).drop("lc")


def idiom_flag() -> Column:
    return flag((C("foreign") >= 3) & (C("native") <= 2), 5, "idiom", "idiom.cross_language.mismatch", "idiom_mismatch", C("foreign") >= 6, 0.7 * C("foreign") / 8 + 0.3 * (2 - C("native")) / 2)


def prompt_flag() -> Column:
    return flag(C("prompts") >= 2, 6, "prompt", "prompt.leakage.markers", "prompt_leakage", C("prompts") >= 4, C("prompts") / 8)


def readme_flag() -> Column:
    return flag((C("sections") >= 5) & (C("phrases") >= 2), 7, "readme", "readme.template.structure", "readme", (C("sections") >= 7) & (C("phrases") >= 3), 0.7 * C("sections") / 9 + 0.3 * C("phrases") / 6)


def add_all(p: DataFrame) -> DataFrame:
    return reduce(lambda p, add: add(p), (add_lexical, add_comments, add_structure, add_test_shape, add_markers, add_readme), p)


def all_flags(comment_threshold: float = 0.45) -> tuple[Column, ...]:
    return lexical_flag(), comment_flag(comment_threshold), structure_flag(), test_flag(), idiom_flag(), prompt_flag(), readme_flag()


def lexical_findings(p: DataFrame) -> DataFrame:
    return emit(add_lexical(p.where(known())), lexical_flag())


def comment_findings(p: DataFrame, threshold: float = 0.45) -> DataFrame:
    return emit(add_comments(p.where(known())), comment_flag(threshold))


def structure_findings(p: DataFrame) -> DataFrame:
    return emit(add_structure(p.where(known())), structure_flag())


def test_findings(p: DataFrame) -> DataFrame:
    return emit(add_test_shape(p.where(known())), test_flag())


def idiom_findings(p: DataFrame) -> DataFrame:
    return emit(add_markers(p.where("ext = 'rs'")), idiom_flag())


def prompt_findings(p: DataFrame) -> DataFrame:
    return emit(add_markers(p.where(C("ext").isin(*PROMPT_EXTENSIONS))), prompt_flag())


def readme_findings(p: DataFrame) -> DataFrame:
    return emit(add_readme(p.where("ext = 'md'")), readme_flag())
