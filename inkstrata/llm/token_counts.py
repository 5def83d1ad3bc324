"""Token counts by overlap resynchronisation.

A text of up to one window is encoded whole by the library. A longer one is encoded as windows that overlap, each with the
offsets of its tokens. Two neighbouring encodings are spliced at a place of their overlap where tokens of both begin and
that is proven stable: one space between two characters that are no white space, where the pre-tokenizer begins a piece
whatever stands further off. So what the left window says up to there, and the right one from there on, is what the whole
text would give. Where the encodings have no such place in common the overlap is widened, and where not even a whole
window holds one the window itself is, at worst to the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import in_slices
from .vocabulary import tokenizer

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Exact token counts of texts of any length; what is encoded at a time is bounded by the window where texts have spaces."""

    def __init__(self, path: str, window: int = 1 << 16, overlap: int = 1 << 10):
        self.whole, self.window, self.overlap = tokenizer(path), window, overlap

    def starts(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where the tokens of text[begin:end] begin in the text; a character of several tokens is listed for each."""
        offsets = self.whole.encode(text[begin:end], add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in offsets), np.int64, len(offsets)) + begin

    @staticmethod
    def stable(text: str, at: int) -> bool:
        return text[at] == " " and 0 < at < len(text) - 1 and not text[at - 1].isspace() and not text[at + 1].isspace()

    def splice(self, text: str, left: np.ndarray, right: np.ndarray, after: int, before: int) -> int:
        """The last stable place in (after, before) where tokens of both encodings begin, or -1."""
        common = np.intersect1d(left[(left > after) & (left < before)], right[(right > after) & (right < before)])
        return next((at for at in map(int, common[::-1]) if self.stable(text, at)), -1)

    def count(self, text: str) -> int:
        if len(text) <= self.window:
            return len(self.whole.encode(text, add_special_tokens=False).ids) if text else 0
        total, done = 0, 0  # tokens before the proven place `done`
        begin, end = 0, self.window
        left = self.starts(text, begin, end)
        while end < len(text):
            overlap, at = self.overlap, -1
            while at < 0:
                again = max(done, end - overlap)
                stop = min(len(text), max(again + self.window, end + overlap))
                right = self.starts(text, again, stop)
                at = self.splice(text, left, right, again, end - 1)
                if at < 0 and again == done:
                    break
                overlap *= 2  # alignment failed in this overlap
            if at < 0:  # not even the whole window has a stable place
                end = min(len(text), done + 2 * (end - done))
                left = self.starts(text, done, end)
                continue
            total += int(((left >= done) & (left < at)).sum())
            done, end, left = at, stop, right
        return total + int((left >= done).sum())


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row a document: bytes, tokens and whether there are more than `limit`.

    A null text counts as empty: no bytes, no tokens. Rows are independent, so repeated rows and null ids keep a row each;
    an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for b in in_slices(batches):
            text = pc.fill_null(b.column(1), "")
            n = pa.array([counter.count(t.as_py()) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
