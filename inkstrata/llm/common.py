"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps every ASCII byte that is no letter or digit to a space and A-Z to a-z; bytes of other characters stay.
WORD_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))

WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Memo(dict):
    """Works out what is missing. Keeps at most `most` entries in two generations: when the younger is full, the older is
    forgotten, so what recurs stays. Python workers live on from task to task and from operator to operator: all memos
    of one worker add up beside the executor's heap."""

    def __init__(self, of: Callable, most: int):
        super().__init__()
        self.of, self.half, self.old = of, most // 2, {}

    def __missing__(self, key):
        got = self.old.pop(key, None)
        if got is None:
            got = self.of(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the cluster shares, named by spark.checkpoint.dir.

    Only a session in one process, as in tests, may do without that setting: its own temporary folder is shared by all.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkstrata-"))
    return df.checkpoint(eager=True)


def kept_rows(documents: DataFrame, judge: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of `documents`, all columns as they are, whose texts the judge lets pass."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            yield b.filter(pa.array(judge(b.column(at)), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(WORD_TABLE).split() if text else []


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few long texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def holdout(doc_id: str, modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep, most: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled texts of at most `most_bytes` bytes, chosen by a hash of doc_id, for fitting.

    Only labels that have such a text count for `most`. A document with several labels counts with the largest; rows
    without id, label or text do not count.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    short = documents.select("doc_id", "text").where(F.octet_length("text") <= most_bytes)
    # Ids alone are shuffled; what is broadcast has `most` rows.
    chosen = short.select("doc_id").distinct().join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]):
    """The model that `fit` makes of a bounded sample, in one task, so that the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("text", "y")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    row = sample.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else fit([])  # no partition at all
