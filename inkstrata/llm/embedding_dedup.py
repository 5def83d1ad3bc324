"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of one label are hashed into shards of bounded size; each shard is indexed once, as one graph. Every vector
queries every shard of its label, block by block. A sample of each block's queries is audited against the whole shard, at
every size of a shard alike. As links may be rare, its nearest neighbours are audited first: if their recall is below the
target, the shard is scanned, which takes less time than wide beams. While recall of its links is below the target the
beam is widened, and a beam that has grown to the whole shard is a scan of it; queries whose beam is full of links are
scanned, too, so neither dense groups nor hard shards lose links. Cosines are verified in double precision. Each block
gives the number of links of its vectors and a spanning forest of the links it found; components join the forests.

Searches and insertions go in batches: all queries of a batch advance one step at a time as numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Vectors of one shard at most, and bytes of their components: what one task holds, as graph and as block of queries.
SHARD, SHARD_BYTES = 12_000, 12 << 20
DEGREE, BEAM, BATCH, AUDIT, TARGET = 12, 24, 512, 64, 0.99
#: Nearest neighbours of each audited query.
NEAREST = 8


class Graph:
    """Navigable small-world graph on layers; row 0 of `layers` holds all vectors, each next one about a DEGREE-th."""

    def __init__(self, unit: np.ndarray, seed: int = 5, stored: bytes | None = None):
        self.unit = np.ascontiguousarray(unit, np.float32)
        n = len(unit)
        rank = np.random.default_rng(seed).permutation(n)
        self.order = np.argsort(rank)  # the first of these make up the upper layers
        sizes = [n]
        while sizes[-1] > 2 * DEGREE:
            sizes.append(max(1, sizes[-1] // DEGREE))
        self.layers: list[np.ndarray] = []
        if stored is not None:
            self._restore(stored, sizes)
            return
        for size in reversed(sizes):  # top first
            self.layers.insert(0, self._build(self.order[:size]))

    def stored(self) -> bytes:
        """The links, layer by layer, of the layer's own vectors."""
        return b"".join(links[self.order[: self._size(k)]].astype("<i4").tobytes() for k, links in enumerate(self.layers))

    def _size(self, layer: int) -> int:
        n = len(self.unit)
        for _ in range(layer):
            n = max(1, n // DEGREE)
        return n

    def _restore(self, data: bytes, sizes: list[int]) -> None:
        flat, at = np.frombuffer(data, "<i4").reshape(-1, 2 * DEGREE), 0
        for size in sizes:
            links = np.full((len(self.unit), 2 * DEGREE), -1, np.int32)
            links[self.order[:size]] = flat[at : at + size]
            self.layers.append(links)
            at += size

    def _build(self, members: np.ndarray) -> np.ndarray:
        """Links of one layer, -1 where free, by inserting in batches that at most double the layer."""
        width = 2 * DEGREE
        links = np.full((len(self.unit), width), -1, np.int32)
        done = 0
        while done < len(members):
            new = members[done : done + max(width, min(BATCH, done))]
            near = []
            if done:
                ids, sims = self._walk(self.unit[new], links, self._enter(self.unit[new], members[:1]), BEAM)
                near.append((ids, sims))
            own = self.unit[new] @ self.unit[new].T
            np.fill_diagonal(own, -2)
            k = min(width, len(new))
            top = np.argpartition(-own, k - 1, 1)[:, :k]
            near.append((np.where(np.take_along_axis(own, top, 1) > -2, new[top], -1).astype(np.int32), np.take_along_axis(own, top, 1)))
            ids, sims = (np.concatenate([x[j] for x in near], 1) for j in (0, 1))
            sims = np.where(ids >= 0, sims, -3)
            best = np.argsort(-sims, 1, kind="stable")[:, : 2 * width]
            kept = self._spread(np.take_along_axis(ids, best, 1), DEGREE)
            links[new, :DEGREE] = kept
            self._back(links, np.repeat(new, DEGREE), kept.ravel())
            done += len(new)
        return links

    def _spread(self, ids: np.ndarray, most: int) -> np.ndarray:
        """Of neighbours from near to far those that are nearer to the vector than to a kept one, then the nearest others."""
        out = np.full((len(ids), most), -1, np.int32)
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            v = self.unit[part]
            between = np.einsum("bid,bjd->bij", v, v, optimize=True)
            own = np.empty(part.shape, np.float32)
            kept = np.zeros(part.shape, bool)
            valid = part >= 0
            # The vector itself isn't at hand here; neighbours are ordered, so a kept one that is very near crowds out.
            for j in range(part.shape[1]):
                crowd = (np.where(kept, between[:, :, j], -1) > 0.97).any(1)
                kept[:, j] = valid[:, j] & ~crowd & (kept.sum(1) < most)
            own[:] = np.where(kept, 0, np.where(valid, 1, 2))
            order = np.argsort(own, 1, kind="stable")[:, :most]
            got = np.take_along_axis(np.where(valid, part, -1), order, 1)
            out[at : at + 256, : got.shape[1]] = got
        return out

    def _back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Adds links back; a full vector keeps half of its links and its nearest others."""
        ok = target >= 0
        source, target = source[ok], target[ok]
        if not len(target):
            return
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, first = np.unique(target, return_index=True)
        for t, more in zip(ends, np.split(source, first[1:]), strict=True):
            row = links[t]
            free = np.flatnonzero(row < 0)
            if len(free) >= len(more):
                row[free[: len(more)]] = more
                continue
            pool = np.unique(np.concatenate([row[row >= 0], more]))
            sims = self.unit[pool] @ self.unit[t]
            near = pool[np.argsort(-sims, kind="stable")]
            keep = near[: len(row) // 2]
            rest = near[len(row) // 2 :]
            # The other half spreads over all that is farther, so that the layer stays connected.
            links[t] = np.concatenate([keep, rest[np.linspace(0, len(rest) - 1, len(row) - len(keep)).astype(int)]])

    def _enter(self, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids = np.repeat(at[:1], len(queries))[:, None].astype(np.int32)
        for links in reversed(self.layers):  # from the top down
            ids = self._walk(queries, links, ids, 4)[0][:, :2]
        return ids

    def _walk(self, queries: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: ids and similarities, best first, -1 and -3 where there are fewer."""
        b = len(queries)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -3, np.float32)
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(start[:, :width] >= 0, np.einsum("bd,bkd->bk", queries, self.unit[start[:, :width]]), -3)
        seen = np.zeros((b, len(self.unit)), bool)
        rows = np.arange(b)
        seen[rows[:, None], np.maximum(ids[:, :width], 0)] = True
        open_ = ids >= 0
        live = rows
        while len(live):
            score = np.where(open_[live], sims[live], -4)
            pick = score.argmax(1)
            alive = score[np.arange(len(live)), pick] > -4
            live, pick = live[alive], pick[alive]
            if not len(live):
                break
            open_[live, pick] = False
            near = np.sort(links[ids[live, pick]], 1)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # a vector may be linked twice
            hit = fresh.any(1)
            r, near, fresh = live[hit], near[hit], fresh[hit]
            if not len(r):
                continue
            seen[np.repeat(r, near.shape[1])[fresh.ravel()], near[fresh]] = True
            s = np.where(fresh, np.einsum("bd,bkd->bk", queries[r], self.unit[near]), -3)
            all_s = np.concatenate([sims[r], s], 1)
            top = np.argpartition(-all_s, beam - 1, 1)[:, :beam]
            sims[r] = np.take_along_axis(all_s, top, 1)
            ids[r] = np.take_along_axis(np.concatenate([ids[r], np.where(fresh, near, -1)], 1), top, 1)
            open_[r] = np.take_along_axis(np.concatenate([open_[r], fresh & (s > -3)], 1), top, 1)
        best = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(queries, np.float32)
        return self._walk(q, self.layers[0], self._enter(q, self.order[:1]), beam)


class Forest:
    """A spanning forest of the links seen so far, a batch of links at a time."""

    def __init__(self, n: int):
        self.root, self.kept = np.arange(n), []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """In rounds every tree with a link to a lesser one hangs on the least; each such link is kept."""
        while True:
            x, y = self.root[a], self.root[b]
            live = np.flatnonzero(x != y)
            if not len(live):
                return
            a, b, x, y = a[live], b[live], x[live], y[live]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            self.kept.append(np.stack([a[first], b[first]], 1))
            up = np.arange(len(self.root))
            up[high[first]] = low[first]
            while (up != (more := up[up])).any():
                up = more
            self.root = up[self.root]

    def links(self) -> np.ndarray:
        return np.concatenate([np.zeros((0, 2), np.int64), *self.kept])


def range_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, audit: int = AUDIT, target: float = TARGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) places with cosine >= least in double precision, batch by batch."""
    n = len(exact)
    margin = np.float32(least - 1e-5)

    def scan(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = graph.unit @ np.asarray(q, np.float32).T >= margin
        found = np.nonzero(near.T)
        return found[0], found[1]

    def verified(q: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(r) > 1_000_000:
            ok = np.concatenate([np.einsum("kd,kd->k", q[r[k : k + 250_000]], exact[c[k : k + 250_000]]) for k in range(0, len(r), 250_000)]) >= least
        else:
            ok = np.einsum("kd,kd->k", q[r], exact[c]) >= least
        return r[ok], c[ok]

    def audited(q: np.ndarray) -> tuple[set, set]:
        """True links and true nearest neighbours of the sample, without its own vectors."""
        sims = graph.unit @ np.asarray(q, np.float32).T
        c, r = np.nonzero(sims >= 1 - 1e-5)
        own = (exact[c] == q[r]).all(1)
        sims[c[own], r[own]] = -3
        c, r = np.nonzero(sims >= margin)
        top = np.argpartition(-sims, min(NEAREST, n) - 1, 0)[:NEAREST]
        return set(zip(r, c, strict=True)), {(k, x) for k, near in enumerate(top.T) for x in near if sims[x, k] > -3}

    def beamed(q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sims = graph.search(q, beam)
        hit = (sims >= margin) & (ids >= 0)
        r, k = np.nonzero(hit)
        return r, ids[r, k], hit.all(1)  # a beam full of links may have left some out

    beam = min(BEAM, n)
    sample = queries[np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int)]
    links, nearest = audited(sample) if beam < n else (set(), set())
    while beam < n:
        ids, sims = graph.search(sample, beam)
        full = ((sims >= margin) & (ids >= 0)).all(1)  # these are scanned again
        got = {(k, x) for k, near in enumerate(ids) for x in near}
        missed = lambda want: sum(x not in got and not full[x[0]] for x in want) > (1 - target) * len(want)  # noqa: B023, E731
        if missed(nearest):
            beam = n
        elif missed(links):
            beam *= 2
        else:
            break
    for at in range(0, len(queries), BATCH):
        q = queries[at : at + BATCH]
        if beam >= n:
            r, c = scan(q)
        else:
            r, c, full = beamed(q, beam)
            if full.any():
                again = np.flatnonzero(full)
                keep = ~full[r]
                r2, c2 = scan(q[again])
                r, c = np.concatenate([r[keep], again[r2]]), np.concatenate([c[keep], c2])
        r, c = verified(q, r, c)
        yield r + at, c


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten() if isinstance(column, pa.ListArray) else column
    return np.asarray(values, np.float64).reshape(-1, size)


def linked(embeddings: DataFrame, least: float = 0.93, shard_rows: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a vector: number of vectors linked directly, the least vec_id reachable, whether that is itself.

    Vectors are compared within equal labels that are not null (and equal lengths). Vectors that are null, empty, zero
    or hold null or non-finite components, and null ids, link with nothing. Equal vectors form one class that is compared
    once; its members count as linked with each other. Rows that repeat a vec_id have the links of their own vector each
    and share the component; ties go to the least vec_id; an empty table gives an empty result; other columns are not read.
    """
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(~bad, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # Scaled so that the largest component is 1: squares of very small or large components neither vanish nor overflow.
    rows = cut(rows.withColumn("v", F.when(F.col("fit"), F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs))))))
    fit = rows.where("fit").withColumn("h", F.xxhash64("v"))
    # Classes are known by a number that the checkpoint fixes, for a vec_id may stand in several.
    classes = fit.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("h").alias("h"))
    classes = cut(classes.withColumn("dim", F.size("v")).withColumn("class", F.monotonically_increasing_id()))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(shard_bytes) / (8 * F.col("dim")))))
    kinds = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / most).cast("int").alias("shards"))
    dealt = classes.join(kinds, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("h", F.lit(3)), F.col("shards")).cast("int"))

    def block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, vectors = [], [], []
        for b in batches:
            ids.append(b.column("class").to_numpy(zero_copy_only=False))
            copies.append(b.column("copies").to_numpy(zero_copy_only=False))
            vectors.append(_matrix(b.column("v"), key[1].as_py()))
        ids, copies, v = np.concatenate(ids), np.concatenate(copies), np.concatenate(vectors)
        by = np.argsort(ids, kind="stable")
        unit = v[by] / np.linalg.norm(v[by], axis=1, keepdims=True)
        stored = [ids[by].astype("<i8").tobytes(), copies[by].astype("<i8").tobytes(), unit.astype("<f8").tobytes(), Graph(unit).stored()]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in stored)], ["label", "dim", "shard", "ids", "copies", "unit", "graph"])

    # Each shard is indexed here, once.
    blocks = cut(dealt.select(F.col("label").cast("string").alias("label"), "dim", "shard", "class", "copies", "v").groupBy("label", "dim", "shard").applyInArrow(block, "label string, dim int, shard int, ids binary, copies binary, unit binary, graph binary"))
    others = blocks.select("label", "dim", *(F.col(c).alias(f"q_{c}") for c in ("shard", "ids", "copies", "unit")))
    # Blocks meet blocks of the same label, each pair once: rows here are blocks of up to shard_rows vectors.
    met = blocks.join(others, ["label", "dim"]).where("shard <= q_shard").repartition("label", "dim", "shard", "q_shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            same = row["shard"] == row["q_shard"]
            load = lambda x, t: np.frombuffer(row[x], t)  # noqa: E731, B023
            a, n_a, u_a = load("ids", "<i8"), load("copies", "<i8"), load("unit", "<f8").reshape(-1, row["dim"])
            b, n_b, u_b = (a, n_a, u_a) if same else (load("q_ids", "<i8"), load("q_copies", "<i8"), load("q_unit", "<f8").reshape(-1, row["dim"]))
            links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            forest = Forest(len(a) + (0 if same else len(b)))
            for q, m in range_links(Graph(u_a, stored=row["graph"]), u_a, u_b, least):
                if same:
                    q, m = q[q != m], m[q != m]
                np.add.at(links_b, q, n_a[m])
                if not same:
                    np.add.at(links_a, m, n_b[q])
                forest.link(q if same else q + len(a), m)
            ids = a if same else np.concatenate([a, b])
            counts = links_b if same else np.concatenate([links_a, links_b])
            kept = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, ids[kept[:, 0]]])), pa.array(np.concatenate([ids, ids[kept[:, 1]]])), pa.array(np.concatenate([counts, np.zeros(len(kept), np.int64)]))], ["a", "b", "n"])

    found = cut(met.mapInArrow(search, "a long, b long, n long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    edges = found.where("a <> b").select("a", "b")
    # A vec_id with several vectors links their classes.
    members = fit.select("vec_id", "label", "v").distinct().groupBy("vec_id").agg(F.count("*").alias("m")).where("m > 1")
    several = cut(fit.join(members, "vec_id").select("vec_id", "label", "v").distinct().join(classes.select("label", "v", "class"), ["label", "v"]).select("vec_id", "class"))
    least_class = several.groupBy("vec_id").agg(F.min("class").alias("b"))
    edges = edges.union(several.join(least_class, "vec_id").select(F.col("class").alias("a"), "b"))
    joined = components(edges)
    told = classes.select("label", "v", "class", "rep", "copies").join(counts, "class", "left").join(joined.withColumnRenamed("id", "class"), "class", "left")
    told = cut(told.select("label", "v", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("c")))
    least_id = told.groupBy("c").agg(F.min("rep").alias("component_id"))
    told = cut(told.join(least_id, "c").select("label", "v", "n_links", "component_id"))
    out = fit.select("vec_id", "label", "v").join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
