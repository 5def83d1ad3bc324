"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

Test texts are cut into windows of consecutive words. The corpus frequency of every test term is counted; each window
is anchored at its two rarest terms, and only for anchors are training postings (term, document, position) stored. A
window's two posting lists, adjusted by the terms' offsets, are intersected by document and start; what is left is
compared word for word with the document, which gives exact phrase matches. `proximity` finds windows whose anchors
stand near each other in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: Separators between words: ASCII characters that are no letters and no digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of the test side, or of hit documents, up to this size are broadcast; beyond it the joins are shuffled.
BROADCAST_BYTES = 32 << 20
#: Two hashes of a row's id and text; rows that are equal in both are one, and one hash alone would not tell 10^11 rows apart.
KEY = ["key", "key2"]


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: wid, words, len, and the items (as strings) that hold them."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size)))
    w = w.select("item", "w", starts.alias("at")).select("item", F.slice("w", F.col("at") + 1, F.least(F.lit(size), F.size("w"))).alias("words"))
    # A null item_id has windows that hit and no name.
    return w.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("wid"), "words", F.size("words").alias("len"), "items")


def keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("key2", F.xxhash64(F.lit(7), "text", "doc_id"))


def _small(df: DataFrame, measured: bool):
    return F.broadcast(df) if measured else df


def _fits(df: DataFrame, size: Column) -> bool:
    """Whether a table, by its own count of bytes, may be broadcast."""
    return (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES


def candidates(documents: DataFrame, items: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """(windows, candidates): candidates are (key, key2, wid, start) where both anchors of a window stand at their offsets."""
    spans = cut(windows(items, size))
    terms = spans.select(F.posexplode("words").alias("off", "term"), "wid", "len")
    test_terms = cut(terms.select("term").distinct())
    few_terms = _fits(test_terms, F.octet_length("term"))
    postings = documents.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    df = postings.select("term").join(_small(test_terms, few_terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    df = cut(df)
    # The rarest and the second rarest term of each window (another place, if the window has several words).
    rank = F.row_number().over(W.partitionBy("wid").orderBy("n", "off"))
    anchors = cut(terms.join(_small(df, few_terms), "term").withColumn("k", rank).withColumn("found", F.count("*").over(W.partitionBy("wid"))).where("k <= 2 and found = len").select("wid", "len", "k", "off", "term"))
    few_anchors = _fits(anchors, F.octet_length("term"))
    # Written before the joins, so that a join by a frequent term is split where it is skewed.
    wanted = cut(anchors.select("term").distinct())
    stored = cut(postings.join(_small(wanted, few_anchors), "term"))
    hits = [stored.join(_small(anchors.where(F.col("k") == k).drop("k"), few_anchors), "term").where("pos >= off").select(*KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), "len") for k in (1, 2)]
    one = hits[0].where("len = 1").drop("len")
    both = hits[0].where("len > 1").drop("len").join(hits[1].drop("len"), [*KEY, "wid", "start"], "left_semi")
    return spans, cut(one.union(both))


def hit_documents(rows: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(key, key2, n_hit, names) of the keyed rows in which a window stands word for word; equal rows are one."""
    spans, found = candidates(rows, items, size)
    few = _fits(spans, F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " ")))
    # Per document: the windows that may stand in it, bounded by its own words.
    listed = found.join(_small(spans, few), "wid").groupBy(*KEY).agg(F.collect_set(F.struct("start", "len", "words", "items")).alias("maybe"))
    # Only texts with candidates are shuffled, if their keys may be broadcast.
    wanted = cut(found.select(*KEY).distinct())
    texts = rows.select(*KEY, "text").join(_small(wanted, _fits(wanted, F.lit(16))), KEY, "left_semi").join(listed, KEY).select(*KEY, "maybe", words(F.col("text")).alias("w"))
    hit = texts.select(*KEY, F.filter("maybe", lambda c: F.slice(F.col("w"), c["start"] + 1, c["len"]) == c["words"]).alias("hit"))
    return cut(hit.where(F.size("hit") > 0).dropDuplicates(KEY).select(
        *KEY,
        F.size(F.array_distinct(F.flatten(F.transform("hit", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda c: c["items"])))).alias("names"),
    ))


def contaminated(documents: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """One row a document: its words, how many of them a test window covers, and which items these are of.

    contaminated: some word is hit, and share * n_hit >= n_words. Texts that are null or have no words have none hit; an
    item without words has no window. Repeated rows of one doc_id and null ids keep a row each and are judged each by
    its own text; no items, or no documents, give no hits; other columns are not read.
    """
    rows = keyed(documents.select("doc_id", "text"))
    met = hit_documents(rows, items, size)
    # Separators at either end leave an empty word there; case does not matter.
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATORS), "")).cast("long")
    out = rows.select("doc_id", *KEY, n_words.alias("n_words")).join(met, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """The rows in which no test window stands, each judged by its own text, with all their columns."""
    found = hit_documents(keyed(documents.select("doc_id", "text")), items, size).select(F.col("key").alias("_k1"), F.col("key2").alias("_k2"))
    hit = _small(found, _fits(found, F.lit(16)))
    same = (F.xxhash64("doc_id", "text") == F.col("_k1")) & (F.xxhash64(F.lit(7), "text", "doc_id") == F.col("_k2"))
    return documents.join(hit, same, "left_anti")


def proximity(documents: DataFrame, items: DataFrame, size: int = 13, within: int = 20) -> DataFrame:
    """(doc_id, item_id as string, first, last): the two rarest terms of a window stand within `within` words of each other.

    A window of one word matches where that stands; a term that is both anchors must stand at two places. Windows of a
    null item_id have a null name.
    """
    rows = keyed(documents.select("doc_id", "text"))
    spans = cut(windows(items, size))
    terms = spans.select(F.posexplode("words").alias("off", "term"), "wid", "len")
    postings = rows.select(*KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    df = postings.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("n"))
    anchors = cut(terms.join(df, "term").withColumn("k", F.row_number().over(W.partitionBy("wid").orderBy("n", "off"))).where("k <= 2").select("wid", "len", "k", "term"))
    near = [postings.join(anchors.where((F.col("k") == k) & (F.col("len") > 1)), "term").select(*KEY, "wid", F.col("pos").alias(f"p{k}"), F.explode(F.array(*([F.floor(F.col("pos") / within)] if k == 1 else [F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)]))).alias("cell")) for k in (1, 2)]
    met = near[0].join(near[1], [*KEY, "wid", "cell"]).where((F.col("p1") != F.col("p2")) & (F.abs(F.col("p1") - F.col("p2")) <= within))
    one = postings.join(anchors.where("len = 1"), "term").select(*KEY, "wid", F.col("pos").alias("p1"), F.col("pos").alias("p2"))
    met = met.select(*KEY, "wid", "p1", "p2").union(one)
    met = met.groupBy(*KEY, "wid").agg(F.min(F.least("p1", "p2")).alias("first"), F.max(F.greatest("p1", "p2")).alias("last"))
    return met.join(spans, "wid").join(rows.select("doc_id", *KEY), KEY).select("doc_id", F.explode_outer("items").alias("item_id"), "first", "last").groupBy("doc_id", "item_id").agg(F.min("first").alias("first"), F.max("last").alias("last"))
