"""Reports of findings as rows of text: annotations, SARIF, JSON, grades and plain lines.

A report is a table (part, place, value). `document` puts its rows in order between the brackets that make them one JSON
document; nothing of it is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import severity_rank
from ..operators import scores as S
from .corpus import cut

C = F.col
ORDER = ("repo", "path", "ord", "id")
NULLS = {"ignoreNullFields": "false"}


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def message() -> Column:
    return F.concat(C("id"), F.lit(" ("), C("severity"), F.lit(")"))


def rule() -> Column:
    return F.concat_ws("/", F.lit("inkstrata"), "category", "id")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds `place`, 0 for the first row in that order: rows are dealt in ranges, numbered in each, and ranges are counted."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range.
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - C("_n")).alias("_before"))
    number = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_no", number).join(F.broadcast(before), "_range").withColumn("place", (C("_before") + C("_no") - 1).cast("long")).drop("_range", "_no", "_before")


def annotations(findings: DataFrame) -> DataFrame:
    """A line for each finding, and a notice with the totals."""
    findings = cut(findings)
    line = F.when(C("line_start").isNull(), F.lit("")).otherwise(F.concat(F.lit(",line="), C("line_start").cast("string")))
    title = F.concat(F.lit(",title=inkstrata["), "category", F.lit("]: "), "id")
    lines = findings.select("repo", "path", "ord", F.concat(F.lit("::error file="), escaped(C("path")), line, title, F.lit("::"), escaped(message())).alias("annotation"))
    none = F.lit(None).cast("string")
    notice = F.concat(F.lit("::notice title=inkstrata summary::"), C("total").cast("string"), F.lit(" finding(s), AI probability "), F.round(100 * F.round("ai_probability", 4)).cast("int").cast("string"), F.lit("%"))
    return lines.unionByName(S.summary(findings).select(none.alias("repo"), none.alias("path"), F.lit(None).cast("long").alias("ord"), notice.alias("annotation")))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Rules in the order in which they first appear, numbered from 0. There are as many rows as there are rules."""
    first = findings.groupBy(rule().alias("rule")).agg(F.min(F.struct(*ORDER)).alias("first"), F.count("*").alias("n"), F.first("category").alias("category"))
    return first.withColumn("rule_index", F.row_number().over(W.orderBy("first", "rule")) - 1).select("rule", "rule_index", "n", "category")


def totals(findings: DataFrame) -> Column | DataFrame:
    s = S.summary(findings).withColumn("ai_probability", F.round("ai_probability", 4))
    return s.select(F.lit("summary").alias("part"), F.lit(0).cast("long").alias("place"), F.to_json(F.struct("total", "low", "medium", "high", "ai_probability")).alias("value"))


def sarif_report(findings: DataFrame) -> DataFrame:
    """Rules, results and totals of a SARIF document; the findings are made once for all of them."""
    findings = cut(findings)
    rules = cut(sarif_rules(findings))
    level = F.when(C("severity") == "high", "error").when(C("severity") == "medium", "warning").otherwise("note")
    # The region is left out without lines, and fixes without a suggestion.
    region = F.when(C("line_start").isNotNull(), F.struct(C("line_start").alias("startLine"), C("line_end").alias("endLine")))
    place = F.struct(F.struct(C("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region"))
    fixes = F.when(C("suggestion").isNotNull(), F.array(F.struct(F.struct(C("suggestion").alias("text")).alias("description"))))
    result = F.struct(
        C("rule").alias("ruleId"), C("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(message().alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"),
        F.struct(F.round("confidence", 4).alias("confidenceScore"), C("suggestion").isNotNull().alias("autoFixable")).alias("properties"), fixes.alias("fixes"),
    )
    # The rules are a table of as many rows as there are ids.
    results = numbered(findings.withColumn("rule", rule()), *ORDER).join(F.broadcast(rules.drop("category")), "rule")
    told = rules.select(F.lit("rule").alias("part"), C("rule_index").cast("long").alias("place"), F.to_json(F.struct(C("rule").alias("id"), F.struct(F.concat("category", F.lit(" detector")).alias("text")).alias("shortDescription"))).alias("value"))
    return told.unionByName(results.select(F.lit("result").alias("part"), "place", F.to_json(result).alias("value"))).unionByName(totals(findings))


def json_report(findings: DataFrame) -> DataFrame:
    """Totals, findings and the contributions of the categories; the findings are made once for all of them."""
    findings = cut(findings)
    fields = F.struct("repo", "path", "id", "category", "severity", F.round("confidence", 4).alias("confidence"), "line_start", "line_end", "suggestion")
    each = numbered(findings, *ORDER).select(F.lit("finding").alias("part"), "place", F.to_json(fields, NULLS).alias("value"))
    # As many rows as there are categories.
    shares = S.contributions(findings).select("category", "n", F.round("contribution", 4).alias("contribution"))
    shares = shares.withColumn("place", (F.row_number().over(W.orderBy("category")) - 1).cast("long"))
    return totals(findings).unionByName(each).unionByName(shares.select(F.lit("category").alias("part"), "place", F.to_json(F.struct("category", "n", "contribution")).alias("value")))


def document(report: DataFrame, frame: list[tuple[str, str, str]]) -> DataFrame:
    """The lines of one JSON document in order: for each (part, opening, closing) of the frame its rows, with commas between."""
    spark, at = report.sparkSession, {part: k for k, (part, _, _) in enumerate(frame)}
    inside = report.where(C("part").isin(*at)).select(F.create_map(*[F.lit(x) for kv in at.items() for x in kv])[C("part")].alias("k"), F.lit(1).alias("side"), "place", F.concat(F.when(C("place") > 0, ",").otherwise(""), "value").alias("value"))
    edges = spark.createDataFrame([(k, side, 0, text) for k, (_, a, b) in enumerate(frame) for side, text in ((0, a), (2, b))], "k int, side int, place long, value string")
    return inside.unionByName(edges).orderBy("k", "side", "place").select("value")


def sarif_document(findings: DataFrame) -> DataFrame:
    head = '{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"inkstrata","rules":['
    return document(sarif_report(findings), [("rule", head, "]}},"), ("result", '"results":[', "],"), ("summary", '"properties":', "}]}")])


def json_document(findings: DataFrame, explain: bool = True) -> DataFrame:
    parts = [("summary", '{"summary":', ","), ("finding", '"findings":[', "]" if explain else "]}")]
    return document(json_report(findings), parts + ([("category", ',"explainability":[', "]}")] if explain else []))


def grade_report(spark: SparkSession, findings: DataFrame) -> DataFrame:
    """A line for each category with findings, with score and grade, and one for the whole."""
    row = lambda name: F.concat(F.rpad(name, 14, " "), F.lpad(F.format_string("%.1f", "score"), 8, " "), F.lpad("grade", 6, " ")).alias("value")
    # Nine categories at most.
    grades = cut(S.category_grades(spark, findings))
    each = grades.where("n > 0").select(F.row_number().over(W.orderBy("grade_category")).alias("place"), row(C("grade_category")))
    return each.unionByName(S.overall(grades).select(F.lit(99).alias("place"), row(F.lit("overall"))))


def text_report(findings: DataFrame, explain: bool = False) -> DataFrame:
    """One line a finding, by file, then severity, then as found; a line of totals; with `explain` the strongest evidence."""
    findings = cut(findings)
    label = F.element_at(F.array(F.lit("LOW"), F.lit("MED"), F.lit("HIGH")), severity_rank(C("severity")) + 1)
    each = findings.select(F.lit(0).alias("k"), "repo", "path", (-severity_rank(C("severity"))).alias("rank"), "ord", F.concat_ws(" ", F.when(C("path") == "", "<repository root>").otherwise(C("path")), label, "id", F.format_number("confidence", 2)).alias("value"))
    none = [F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("rank")]
    total = S.summary(findings).select(F.lit(1).alias("k"), *none, F.lit(0).cast("long").alias("ord"), F.format_string("%d finding(s): HIGH %d MED %d LOW %d, AI likelihood %.0f%%", "total", "high", "medium", "low", 100 * C("ai_probability")).alias("value"))
    out = each.unionByName(total)
    if explain:
        top = S.evidence(findings).select(F.lit(2).alias("k"), *none, "ord", F.format_string("%s %s contributes %.2f", "path", "id", "contribution").alias("value"))
        out = out.unionByName(top)
    return out.orderBy("k", "repo", "path", "rank", "ord").select("value")


def calibration(findings: DataFrame, path: str, baseline_threshold: float | None = None) -> str:
    """Writes the recommended settings, one row of bounded size, as a TOML file on the driver, and returns its text."""
    row = S.calibrate(findings, baseline_threshold).first()
    text = f'[severity]\nminimum = "{row.min_severity}"\n\n[detectors]\ncomment_high_density_threshold = {row.comment_threshold}\n'
    with open(path, "w") as f:
        f.write(text)
    return text
