"""Which lines match: tests over all lines of many files at a time by RE2, whose time grows with the text alone.

RE2's classes are ASCII, as in the SQL of the queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files that are tested at once.
SLICE = 512


@dataclass(frozen=True)
class LineTest:
    name: str
    pattern: str
    fold: bool = False
    #: Files of other extensions have no matches; (): all files.
    extensions: tuple[str, ...] = ()


def wider(pattern: str) -> str:
    """A pattern that also matches where letters and spaces beyond ASCII are taken for words' or for spaces'."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        more = {r"\s": r"\s\v\x{80}-\x{10ffff}", r"\w": r"\w\x{80}-\x{10ffff}"}.get(part)
        out += part if more is None else more if inside else f"[{more}]"
        inside = part == "[" or (inside and part != "]")
        at += len(part)
    return out


def _numbers(lists: pa.Array, ext: pa.Array, tests: tuple[LineTest, ...]) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    text, row = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    no = (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + 1).astype(np.int32)
    chosen: dict[tuple[str, ...], tuple] = {(): (text, row, no)}
    out = []
    for t in tests:
        if t.extensions not in chosen:
            here = pc.fill_null(pc.is_in(ext, pa.array(t.extensions, pa.string())), False).to_numpy(zero_copy_only=False)[row]
            chosen[t.extensions] = text.filter(pa.array(here)), row[here], no[here]
        some, of, at = chosen[t.extensions]
        hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(some, t.pattern, ignore_case=t.fold), False).to_numpy(zero_copy_only=False))
        ends = np.cumsum(np.bincount(of[hit], minlength=len(sizes)))
        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(at[hit], pa.int32())))
    return pa.StructArray.from_arrays(out, [t.name for t in tests])


def matching(tests: tuple[LineTest, ...]) -> Column:
    """A field for each test: the numbers, from 1, of the elements of `lines` that match, in order. Needs `lines` and `ext`."""

    @F.arrow_udf(returnType="struct<" + ",".join(f"{t.name}:array<int>" for t in tests) + ">")
    def run(lists: pa.Array, ext: pa.Array) -> pa.Array:
        return pa.concat_arrays([_numbers(lists.slice(k, SLICE), ext.slice(k, SLICE), tests) for k in range(0, max(1, len(lists)), SLICE)])

    return run("lines", "ext")


def flagged(pattern: str, texts: str) -> Column:
    """For each element of an array column whether the pattern, folded, matches it."""

    @F.arrow_udf(returnType="array<boolean>")
    def run(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        hit = pc.match_substring_regex(lists.flatten(), pattern, ignore_case=True)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), hit)

    return run(texts)
