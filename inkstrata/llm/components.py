"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges of one task.
ROWS = 100_000
#: Edges up to this number, 16 bytes each, are joined in one task; beyond it in rounds over all tasks.
ONE_TASK = 2_000_000


def least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components) of the ends of edges: roots hang on lesser roots until no edge lies between two."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return ids, ids[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            found = pa.RecordBatch.from_arrays([pa.array(x) for x in least(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))], ["id", "component"])
            yield from (found.slice(k, ROWS) for k in range(0, found.num_rows, ROWS))

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable, for every end of an edge (a, b: long) that is no loop.

    The edges are read twice, so they should be written. Few edges are joined in one task, for a round over all costs the
    driver a dozen stages, whatever the data. More edges go through large-star and small-star steps until nothing changes:
    a number of rounds that grows with the logarithm of the longest path. Every step is a minimum by key, combined before
    the shuffle and written, and a join of written tables, which is split where one id is hot. Duplicate edges and loops do
    no harm; an empty list gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    if pairs.count() <= ONE_TASK:
        return cut(_in_one_task(pairs))
    pairs = cut(pairs.distinct())
    # As many tasks as the edges need, at ROWS each, however many partitions shuffles have: rounds are many and short.
    tasks, last = max(8, -(-pairs.count() // ROWS)), None
    cut_few = lambda df: cut(df.coalesce(tasks))
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = cut_few(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        # Large star: neighbours that are larger than u hang on the least of its neighbourhood.
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang on the least of these.
        down = cut_few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = cut_few(small.where("u > v").distinct())
        now = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
