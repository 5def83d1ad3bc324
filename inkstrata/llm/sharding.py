"""Sharding by vector bin packing.

Bytes, tokens and rows of each group of equal texts are balanced together. Groups too large for a fraction of a shard
are split into pieces; all others are dealt by a hash of the text into a fixed number of buckets, so what is placed on
the driver (pieces and buckets) is bounded by parameters and not by the data. Items are placed largest first, each
where the dot product of its vector with the residual capacity is highest among the shards that have room for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: Rows of one window partition when slots are numbered.
SLOT_ROWS = 20_000


def place(items: np.ndarray, shards: int, weights: tuple[float, ...]) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows), by decreasing size and highest dot product with the residual."""
    total = np.maximum(items.sum(0), 1)
    share = items / total * shards  # 1: a whole shard
    left = np.ones((shards, items.shape[1]))
    scale = np.asarray(weights)
    out = np.zeros(len(items), int)
    for k in np.argsort(-(share * scale).sum(1), kind="stable"):
        room = (left >= share[k] - 1e-9).all(1)
        fit = np.where(room, (left * share[k] * scale).sum(1), -np.inf) if room.any() else (left * scale).min(1)
        out[k] = int(np.argmax(fit))
        left[out[k]] -= share[k]
    return even_out(items, out, shards)


def even_out(items: np.ndarray, shard: np.ndarray, shards: int, spread: float = 0.02, rounds: int = 20_000) -> np.ndarray:
    """Moves or swaps items between the largest and the smallest shard while that lowers their difference in bytes.

    No step takes another measure of either shard further than `spread` from its mean, unless it is nearer to it than before.
    """
    load = np.stack([np.bincount(shard, items[:, j], shards) for j in range(items.shape[1])], 1)
    mean = np.maximum(load.mean(0), 1)
    none = np.zeros((1, items.shape[1]))  # a move without return
    for _ in range(rounds):
        high, low = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[high, 0] - load[low, 0]
        a, b = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
        if not len(a):
            break
        back = np.concatenate([none, items[b]])
        order = np.argsort(back[:, 0], kind="stable")
        near = np.searchsorted(back[order, 0], items[a, 0] - gap / 2)[None] + np.arange(-4, 4)[:, None]
        pick = order[np.clip(near, 0, len(order) - 1)]
        diff = items[a][None] - back[pick]
        off = lambda x: np.abs(x / mean - 1)[..., 1:]
        fine = np.ones(pick.shape, bool)
        for before, after in ((load[high], load[high] - diff), (load[low], load[low] + diff)):
            fine &= ((off(after) <= spread) | (off(after) < off(before))).all(-1)
        good = np.where(fine & (diff[..., 0] > 0) & (diff[..., 0] < gap), np.abs(diff[..., 0] - gap / 2), np.inf)
        if not np.isfinite(good.min()):
            break
        way, i = np.unravel_index(int(good.argmin()), good.shape)
        j = pick[way, i]
        shard[a[i]] = low
        if j:
            shard[b[j - 1]] = high
        load[high] -= diff[way, i]
        load[low] += diff[way, i]
    return shard


def shard(documents: DataFrame, shards: int = 40, buckets: int = 4096, piece: float = 0.25, weights: tuple[float, float, float] = (1.0, 0.3, 0.3)) -> DataFrame:
    """One row a document: its shard, and its slot there.

    The law is `bytes`: sizes (UTF-8 bytes plus 16) of the shards are near equal; tokens (runs without white space) and
    rows are balanced with them and stay within a fiftieth of their mean where the groups allow it. Equal texts share a shard unless they are more than `piece` of one in any measure. A null text counts
    as no bytes and is a group of its own kind. Repeated rows and null ids get a slot each; an empty table gives an
    empty result; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("h"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        # Differs by row, also where ids and texts do not; fixed by the checkpoint.
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("h", "text_crc32").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens", "rows"))).first()
    at_most = {c: max(1.0, total[c] / shards * piece) for c in ("bytes", "tokens", "rows")}
    parts = F.ceil(F.greatest(*(F.col(c) / F.lit(at_most[c]) for c in at_most))).cast("int")
    # A group of one row can't be split; the others number at most 3 * shards / piece.
    groups = groups.withColumn("parts", F.when((parts > 1) & (F.col("rows") > 1), F.least(parts, F.col("rows").cast("int"))).otherwise(1))
    heavy = groups.where("parts > 1").orderBy("h", "text_crc32").collect()
    spark, first, at = documents.sparkSession, [], buckets
    for r in heavy:
        first.append((r.h, r.text_crc32, at, r.parts))
        at += r.parts
    split = spark.createDataFrame(first, "h long, text_crc32 long, first int, parts int")
    # Both tables that are broadcast have at most buckets + 3 * shards / piece rows, whatever the size of the data.
    dealt = (
        rows.join(F.broadcast(split), ["h", "text_crc32"], "left")
        .withColumn("salt", F.xxhash64(F.col("row"), F.lit(7)))
        .withColumn("unit", F.when(F.col("first").isNull(), F.pmod("h", F.lit(buckets)).cast("int")).otherwise(F.col("first") + F.pmod("salt", "parts").cast("int")))
    )
    units = dealt.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("unit").collect()
    to = place(np.array([(r.bytes, r.tokens, r.rows) for r in units], float).reshape(-1, 3), shards, weights)
    plan = spark.createDataFrame([(r.unit, int(s)) for r, s in zip(units, to, strict=True)], "unit int, shard int")
    dealt = dealt.join(F.broadcast(plan), "unit")
    # Slots: parts of a unit of about SLOT_ROWS rows are numbered alone and laid one after the other.
    fine = max(1, -(-int(total["rows"]) // (buckets * SLOT_ROWS)))
    dealt = dealt.withColumn("bit", F.pmod(F.shiftright("salt", 20), F.lit(fine)).cast("int"))
    counts = cut(dealt.groupBy("shard", "unit", "bit").agg(F.count("*").alias("n")))
    before = counts.select("shard", "unit", "bit", (F.sum("n").over(W.partitionBy("shard").orderBy("unit", "bit")) - F.col("n")).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "unit", "bit").orderBy("doc_id", "size", "row"))
    return (
        dealt.withColumn("at", number).join(before, ["shard", "unit", "bit"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
