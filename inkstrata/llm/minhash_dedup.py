"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is hashed into one of the coordinates with the value i + h(shingle); a coordinate keeps
its least value. The first rounds fill most coordinates, and rounds from the number of coordinates on fill one fixed
coordinate each, so every coordinate is full after twice as many rounds for any set, and coordinates of a set are nearly
drawn without replacement, which gives the concentration that independent ones would.

Candidates: equal texts are one node, and nodes with the same set form one class, whose members are verified against its
least node like any pair. Of each class one node goes on. Nodes that agree in a band meet in a bucket; each is paired with
the bucket's hub, the node that meets most others in all its buckets; these pairs are verified on the full shingle sets,
and components are formed. Only members of a hub's buckets that then lie in different components are paired with each
other, if their lengths, their measured distances from the hub (Jaccard distance keeps the triangle inequality) and their
sketches allow the wanted similarity; those are verified, and components formed again. So copies are never expanded into
all their pairs, and no pair that a band brings together is left out unless it is connected anyway. Joins by a key that
may be hot (hub, class, text) are dealt by that key and a salt, or join written tables, which Spark splits where skewed;
merge hints keep tables that grow with the corpus from being collected for a broadcast. Rows of the corpus are found again
by a broadcast bit set of at most 8 MB and an exact join of what passes it. Each stage costs the driver memory, whatever
the data, so there are few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, in_slices
from .components import components

SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"
SKETCHED = "doc_id long, h1 long, h2 long, n long, set_hash binary, bands array<long>, sketch array<long>"
#: Two hashes of a text: rows that are equal in both hold the same text, and are one node.
TEXT = ["h1", "h2"]
#: Outsiders of one hub that meet its members together.
OUTSIDERS = 1024
#: Classes of texts with the same set up to this number are broadcast.
BROADCAST_ROWS = 100_000
#: Bits of a broadcast bit set: 8 MB.
MOST_BITS = 1 << 26
#: Coordinates of the sketch beyond which bands need none, for estimates; four bits of each are kept.
ESTIMATE = 384
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def banding(similarity: float, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the fewest coordinates among 4 to 6 rows that miss a pair at `similarity` with at most `miss`."""
    rows = 6 if similarity >= 0.85 else 5 if similarity >= 0.75 else 4
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows))), rows


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, size: int) -> frozenset[bytes]:
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 300_000)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(hashes: np.ndarray, k: int) -> np.ndarray:
    """k 64-bit coordinates: the round in the high bits (all other bits from the hash), least value wins."""
    best = np.full(k, np.uint64(0xFFFFFFFFFFFFFFFF))
    at, n = 0, len(hashes)
    with np.errstate(over="ignore"):
        while at < 2 * k:
            step = int(min(2 * k - at, max(2, 4 * k // n))) if at < k else 2 * k - at
            if at < k:
                step = min(step, k - at)
            rounds = np.arange(at, at + step, dtype=np.uint64)
            h = _mix(hashes[None] + (rounds[:, None] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            value = (rounds[:, None] << np.uint64(48)) | (h >> np.uint64(16))
            where = (_mix(h ^ _M1) % np.uint64(k)) if at < k else np.broadcast_to((rounds - np.uint64(k))[:, None], h.shape)
            np.minimum.at(best, where.ravel().astype(np.intp), value.ravel())
            at += step
            if best.max() != np.uint64(0xFFFFFFFFFFFFFFFF):
                break
    return best


def sketched(documents: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: size and hash of its set, the keys of its bands, and four bits of each coordinate."""
    k = bands * rows
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for b in in_slices(batches):
            n, sets, keys, bytes_ = [], [], [], []
            for text in b.column(3):
                h = shingle_hashes(text.as_py(), size)
                n.append(len(h))
                if not len(h):
                    sets.append(None), keys.append(None), bytes_.append(None)
                    continue
                s = sketch(h, max(k, ESTIMATE))
                bits = _mix(s[:ESTIMATE]) & np.uint64(15)
                band = at.copy()
                for column in s[:k].reshape(bands, rows).T:
                    band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + column)
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                keys.append(band.view(np.int64))
                bytes_.append(np.bitwise_or.reduce(bits.reshape(-1, 16) << shifts, 1).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.list_(pa.int64()))], [f.split()[0] for f in SKETCHED.split(", ")])
        _word_hashes.cache_clear()  # the worker lives on, and later operators have memos of their own

    return hashed(documents).mapInArrow(run, SKETCHED)


def hashed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")


def _key(doc_id: str = "doc_id"):
    return F.xxhash64(*TEXT, doc_id).alias("key")


def _may_hold(keys: DataFrame) -> tuple[DataFrame, Column]:
    """(table of one row, condition): for a join that keeps all rows whose `key` is among the keys, and a few others.

    Two bits of a broadcast bit set for each key, which one task sets; at 16 bits a key about one other row in 70 passes,
    and more beyond MOST_BITS, so an exact join must follow.
    """
    words = 1 << max(4, min(MOST_BITS // 64, max(1, keys.count()) // 4).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            for x in (k, k >> np.uint64(32)):
                np.bitwise_or.at(bits, ((x >> np.uint64(6)) % np.uint64(words)).astype(np.intp), np.uint64(1) << (x & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array([bits.view(np.int64)], pa.list_(pa.int64()))], ["bits"])

    set_ = lambda by: f"shiftright(bits[cast(shiftrightunsigned(key, {by + 6}) & {words - 1} as int)], cast(shiftrightunsigned(key, {by}) & 63 as int)) & 1 = 1"
    return F.broadcast(keys.select("key").coalesce(1).mapInArrow(run, "bits array<long>")), F.expr(f"{set_(0)} and {set_(32)}")


def _first(rows: DataFrame, wanted: DataFrame, value: Column) -> DataFrame:
    """wanted (key, TEXT, more) with the `value` of one row each that has their key and text. Only rows that may be wanted
    are shuffled, and those that repeat each other are combined before."""
    own = rows.join(*_may_hold(wanted), "left_semi").groupBy("key", *TEXT).agg(F.first(value).alias("value"))
    return own.join(wanted.hint("merge"), ["key", *TEXT])


def _similarities(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs (a, b, more) with shared and united: sizes of intersection and union of the full shingle sets of each pair;
    texts: (node, text). Both should be written, so that Spark splits the joins where a node has many partners."""
    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    more = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, frozenset()
        for batch in in_slices(batches, 128):
            shared, united = [], []
            for b, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if b != last:
                    last, held = b, shingle_set(y, size)
                own = shingle_set(x, size)
                shared.append(len(own & held))
                united.append(len(own) + len(held) - shared[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(united, pa.int64()), *batch.columns[4:]], ["a", "b", "shared", "united", *more])

    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b", *more)
    return joined.mapInArrow(run, ", ".join(["a long, b long, shared long, united long", *(f"{c} {kind}" for c, kind in pairs.dtypes if c in more)]))


def _clusters(documents: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, nodes, found): per row doc_id, the hashes of its text and the size of its set; per different text with
    words its node; and of each node with a verified link its component. Ids that stand for several texts link nothing here."""
    bands, rows = banding(percent / 100)
    marks = cut(sketched(documents, size, bands, rows))
    worded = marks.where("n > 0")
    # Sets that several texts have; of these texts the one with the least first hash stands for its class.
    classes = cut(worded.groupBy("set_hash").agg(F.min("h1").alias("rep"), F.max("h1").alias("top")).where("rep < top").drop("top"))
    light = F.struct("n", "set_hash", "bands", "sketch")
    # What equal texts share is combined before the shuffle; the number is fixed by the checkpoint.
    nodes = worded.groupBy(*TEXT).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first(light).alias("m")).select("*", "m.*").drop("m")
    nodes = cut(nodes.join(_small(classes), "set_hash", "left").withColumn("node", F.monotonically_increasing_id()))
    same = cut(nodes.where("h1 <> rep").select("set_hash", F.col("node").alias("a")).join(nodes.where("h1 = rep").select("set_hash", F.col("node").alias("b")).hint("merge"), "set_hash").select("a", "b"))
    reps = nodes.where("rep is null or h1 = rep")
    keyed = reps.select(F.explode("bands").alias("key"), "node")
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = cut(keyed.join(shared.hint("merge"), "key"))
    weight = members.groupBy("node").agg(F.sum("m").alias("weight"))
    hubs = cut(members.join(weight.hint("merge"), "node").groupBy("key").agg((-F.max(F.struct("weight", -F.col("node")))["col2"]).alias("hub")))
    members = cut(members.select("key", "node").join(hubs.hint("merge"), "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())

    # One row's text for each node that any pair may need; the other rows with that text do not leave their partition.
    pairs = members.select("a", "b", F.lit(True).alias("met")).union(same.select("a", "b", F.lit(False)))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(ends.join(nodes.select("node", *TEXT, _key()).hint("merge"), "node"))
    texts = cut(_first(hashed(documents).withColumn("key", _key()), wanted, F.col("text")).select("node", F.col("value").alias("text")))

    linked = 100 * F.col("shared") >= percent * F.col("united")
    tested = cut(_similarities(pairs, texts, size))
    found = components(tested.where(linked).select("a", "b"))

    # Hubs whose buckets still hold several components: members outside the hub's component meet all the others.
    known = lambda x, c: found.select(F.col("id").alias(x), F.col("component").alias(c)).hint("merge")
    near = tested.where("met").select(F.col("b").alias("hub"), F.col("a").alias("node"), (F.col("shared") / F.col("united")).alias("j"))
    labelled = near.join(known("node", "c"), "node", "left").join(known("hub", "hc"), "hub", "left")
    labelled = cut(labelled.select("hub", "node", "j", F.coalesce("c", "node").alias("c"), F.coalesce("hc", "hub").alias("hc")))
    chunks = cut(labelled.where("c <> hc").groupBy("hub").agg(F.ceil(F.count("*") / OUTSIDERS).cast("int").alias("chunks")))
    if not chunks.isEmpty():
        here = cut(labelled.join(chunks.hint("merge"), "hub").join(reps.select("node", "n", "sketch").hint("merge"), "node"))
        side = lambda df, x: df.select(*(F.col(c).alias(f"{d}_{x}") for c, d in (("hub", "hub"), ("chunk", "chunk"), ("j", "j"), ("c", "c"), ("n", "n"), ("sketch", "s"))), F.col("node").alias(x), F.col("hc").alias(f"hc_{x}"))
        left = side(here.where("c <> hc").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")), "a")
        inside = side(here.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))), "b")
        # A pair of two outsiders is met from its larger end only.
        may = (
            (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("hc_b")) | (F.col("a") > F.col("b")))
            & (F.abs(F.col("j_a") - F.col("j_b")) <= 1 - percent / 100 + 1e-9)
            & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & F.expr(_agree(percent / 100))
        )
        together = (F.col("hub_a") == F.col("hub_b")) & (F.col("chunk_a") == F.col("chunk_b"))
        pairs = cut(left.join(inside.hint("merge"), together & may).select("a", "b").distinct())
        more = cut(_similarities(pairs, texts, size).where(linked).select("a", "b"))
        if not more.isEmpty():
            found = components(found.select("id", "component").toDF("a", "b").union(more))
    return marks.select("doc_id", *TEXT, "n"), nodes.select("node", *TEXT, "doc_id", "rows"), found


def near_duplicates(documents: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """One row a document: the size of its shingle set, the least doc_id of its component, and whether that is itself.

    Links: 100 * |intersection| >= percent * |union| of shingle sets. Texts that are null, empty or without words have
    size 0 and link with nothing; a null doc_id links with nothing, has no component and is kept. Rows that repeat a
    doc_id count as one document whose links are those of all its texts, and keep a row each. Ties are broken by the
    least doc_id; an empty table gives an empty result; other columns are not read.
    """
    documents = documents.select("doc_id", "text")
    marks, nodes, found = _clusters(documents.where("doc_id is not null"), percent, size)
    # A doc_id with several texts links their nodes; a node's documents are known by its least doc_id.
    worded = marks.where("n > 0")
    several = worded.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in TEXT for f in (F.min, F.max))).where("min_h1 < max_h1 or min_h2 < max_h2")
    several = cut(several.select("doc_id"))
    if not several.isEmpty():
        ends = cut(worded.join(several.hint("merge"), "doc_id").select("doc_id", *TEXT).distinct().join(nodes.select(*TEXT, "node").hint("merge"), TEXT).select("doc_id", "node"))
        edges = ends.join(ends.groupBy("doc_id").agg(F.min("node").alias("a")).hint("merge"), "doc_id").select("a", F.col("node").alias("b"))
        found = components(cut(found.toDF("a", "b").union(edges)))
    grouped = nodes.join(found.withColumnRenamed("id", "node").hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("rows").alias("all")).where("all > 1")
    # Documents that share their component with no other row are their own.
    named = cut(grouped.join(least.hint("merge"), "component").select(*TEXT, "component_id"))
    out = marks.join(named.hint("merge"), TEXT, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = sketched(documents.where("doc_id is null"), size, 1, 1).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def _agree(similarity: float) -> str:
    """SQL: the kept bits agree in as many coordinates as at `similarity`, less five standard deviations."""
    chance = similarity + (1 - similarity) / 16
    need = max(0, math.floor(ESTIMATE * chance - 5 * math.sqrt(ESTIMATE * chance * (1 - chance))))
    differ = []
    for i in range(ESTIMATE // 16):
        x = f"(s_a[{i}] ^ s_b[{i}])"
        two = f"({x} | shiftrightunsigned({x}, 1))"
        differ.append(f"bit_count(({two} | shiftrightunsigned({two}, 2)) & 1229782938247303441L)")  # the lowest of every four bits
    return f"({' + '.join(differ)}) <= {ESTIMATE - need}"


def keep_one(documents: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each component of near copies, with all its columns: one with the least doc_id, ids that are null last.

    Rows are judged by their texts, whatever their doc_id, so of rows that repeat a document one stays, too. Rows
    without words link with nothing and stay.
    """
    _, nodes, found = _clusters(documents.select("doc_id", "text"), percent, size)
    grouped = nodes.join(found.withColumnRenamed("id", "node").hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node"))["node"].alias("best"), F.sum("rows").alias("all")).where("all > 1")
    judged = cut(grouped.join(best.hint("merge"), "component").select(*TEXT, "doc_id", (F.col("node") == F.col("best")).alias("best"), "rows"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    # Rows whose text surely stays, and of the others those that do; only the latter are shuffled.
    gone = cut(judged.where("not best or rows > 1").select(*TEXT, F.col("h1").alias("key")))
    held, may = _may_hold(gone)
    keyed = rows.withColumn("key", F.col("h1"))
    sure = keyed.join(held, may, "left_anti").select("row.*")
    rest = keyed.join(held, may, "left_semi").join(gone.select(*TEXT).hint("merge"), TEXT, "left_anti").select("row.*")
    # Of a text that several rows hold and that stays, one row with the least doc_id: combined before the shuffle.
    once = cut(judged.where("best and rows > 1").select(*TEXT, _key()))
    first = _first(rows.withColumn("key", F.xxhash64(*TEXT, F.col("row")["doc_id"])), once, F.col("row")).select("value.*")
    return sure.unionByName(rest).unionByName(first)


def _small(hashes: DataFrame) -> DataFrame:
    """For a broadcast where rows of some 100 bytes take 10 MB at most; beyond that the join is shuffled."""
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes.hint("merge")
