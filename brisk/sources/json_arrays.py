"""JSON files that hold one array of any size, read by many tasks.

A file is read as records that end in `}`, block by block. What a block of text does to a reader
depends on two things only: whether it begins inside a string, and how deep. So each block is first
summed up for both cases (whether it ends in a string, the change of depth, elements that end at each
depth); a small table of these, a row for each block, says how each block really begins and how many
elements end before it. Then each block gives the elements that lie within it, and the pieces of those
that reach over its edges, which are put together by their number. A task holds one element at most.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(r'\\.|["\[\]{}]', re.S)


class Reader:
    """Goes through text from a state: inside a string or not, and depth."""

    def __init__(self, quoted: bool = False, depth: int = 0):
        self.quoted, self.depth = quoted, depth

    def ends(self, text: str) -> Iterator[tuple[int, int]]:
        """Place and new depth where something opened is closed."""
        for m in _MARK.finditer(text):
            c = m[0]
            if self.quoted:
                self.quoted = c != '"'
            elif c == '"':
                self.quoted = True
            elif c in "{[":
                self.depth += 1
            elif c in "}]":
                self.depth -= 1
                yield m.end(), self.depth


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, state): what each block does from either start, as JSON."""
    place, both = None, []

    def out() -> pa.RecordBatch:
        state = [[r.quoted, r.depth, sorted(n.items())] for r, n in both]
        return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([json.dumps(state)])], ["file", "block", "state"])

    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != place:
                if place:
                    yield out()
                place, both = (file, block), [(Reader(False), Counter()), (Reader(True), Counter())]
            for reader, closed in both:
                closed.update(depth for _, depth in reader.ends(value + "}"))
    if place:
        yield out()


def _starts(rows: list) -> dict[tuple[str, int], tuple[bool, int, int, bool]]:
    """How each block begins: in a string, depth, elements that ended before it; and whether it is the file's last."""
    out, file = {}, None
    rows = sorted((r["file"], r["block"], json.loads(r["state"])) for r in rows)
    for i, (name, block, both) in enumerate(rows):
        if name != file:
            file, quoted, depth, done = name, False, 0, 0
        out[name, block] = (quoted, depth, done, i + 1 == len(rows) or rows[i + 1][0] != name)
        quoted, change, closed = both[quoted]
        done += dict(map(tuple, closed)).get(1 - depth, 0)
        depth += change
    return out


def array_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(json, file, position) of the elements of arrays, positions from 1. What does not fit into an array
    (a wrong or missing separator, an unfinished element, text behind the end) is an element too, with
    all that belongs to it, so that it is no JSON object."""
    pieces = spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sent = spark.sparkContext.broadcast(_starts(pieces.mapInArrow(_summed, "file string, block long, state string").collect()))  # a row for each block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, reader, held, number, first, last, rows = None, None, [], 0, True, False, []

        def emit(whole: bool) -> None:
            rows.append((place[0], number, place[1], whole, "".join(held)))
            held.clear()

        def out() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, ["file", "position", "block", "whole", "text"])

        for batch in batches:
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != place:
                    if place:
                        emit(False)
                    place = (file, block)
                    quoted, depth, number, last = sent.value[place]
                    reader, first = Reader(quoted, depth), True
                value, at = value + "}", 0
                for end, depth in reader.ends(value):
                    if depth == 1:
                        held.append(value[at:end])
                        emit(not first)
                        at, number, first = end, number + 1, False
                held.append(value[at:])
            if len(rows) >= 1000:
                yield out()
        if place:
            emit(False)
        yield out()

    parts = pieces.mapInArrow(cut, "file string, position long, block long, whole boolean, text string")
    joined = parts.where("not whole").groupBy("file", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    every = parts.where("whole").select("file", "position", "text").unionByName(joined)
    text = F.regexp_replace("text", "^\\ufeff?\\s+|^\\ufeff|\\s+$", "")
    # the record after the last `}` got one too many
    finished = F.regexp_like(text, F.when(F.col("position") == 0, F.lit(r"^\[\s*\]\s*\}$")).otherwise(F.lit(r"^\]\s*\}$")))
    opening = F.when(F.col("position") == 0, F.lit("[")).otherwise(F.lit(","))
    element = F.when(text.startswith(opening), F.regexp_replace(F.substring(text, F.lit(2), F.length(text)), r"^\s+", "")).otherwise(F.concat(F.lit("?"), text))
    return every.where(~finished).select(element.alias("json"), "file", (F.col("position") + 1).alias("position"))
