"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared lower-cased, with each run of white space as one space. An item of n
characters may occur with up to k = floor(rate * n) edits (fewer where its pieces would get shorter than
MIN_PIECE). It is split into k + 1 pieces: whatever k edits do, one piece stays whole. An automaton of all
pieces scans each whole text once; every piece hit gives one stretch of text that can hold the item, and
Myers' bit-parallel distance decides it exactly.

The items go to all tasks, in parts of at most PART_BYTES, one scan a part; the driver holds one part at a time,
a Python worker builds a part's automaton once for all its tasks, and documents are never shuffled.

Defined results: null and empty texts and items match nothing; items are told apart by item_id and text, so
repeated items give repeated rows, as do repeated documents. An item shorter than MIN_PIECE is matched
without edits. Positions count characters of the normalised text. item_id may have any type; other columns,
whatever their names, are ignored by leaks() and kept by clean(). Empty tables give no rows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestra.llm.common import small_batches
from lodestra.llm.workers import working

RATE, MIN_PIECE, PART_BYTES = 0.05, 8, 32 << 20
_KEPT = 20_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """One item as a bit-parallel automaton (Myers, 1999)."""

    def __init__(self, text: str, rate: float):
        self.text, self.n = text, len(text)
        self.errors = max(0, min(int(rate * self.n), self.n // MIN_PIECE - 1))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        step = self.n / (self.errors + 1)
        cuts = [round(step * i) for i in range(self.errors + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def best(self, window: str) -> tuple[int, int]:
        """The least distance of the item to a substring of the window, and where the first such ends."""
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, now = full, 0, self.n
        least, end = self.n, 0
        for at, c in enumerate(window):
            equal = self.masks.get(c, 0)
            vertical = equal | minus
            cross = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | ~(cross | plus) & full, plus & cross
            now += bool(up & high) - bool(down & high)
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(vertical | up) & full, up & vertical
            if now < least:
                least, end = now, at + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, Pattern(t, rate)) for i, t in items if t]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, pattern) in enumerate(self.items):
            for offset, piece in pattern.pieces:
                places.setdefault(piece, []).append((number, offset))
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.kept: dict[tuple[int, str], tuple[int, int]] = {}

    def find(self, raw: str | None) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end) of the best place of each item that the text holds; the end is
        exact and the start is the earliest one possible for it."""
        if not self.items:
            return []
        text = normal(raw)
        tried: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int, int]] = {}
        for at, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                start = at + 1 - length - offset
                if (number, start) in tried:
                    continue
                tried.add((number, start))
                pattern = self.items[number][1]
                if text.startswith(pattern.text, max(start, 0)) and start >= 0:
                    distance, end = 0, start + pattern.n
                else:
                    low = max(0, start - pattern.errors)
                    window = text[low : start + pattern.n + pattern.errors]
                    known = self.kept.get((number, window))
                    if known is None:
                        if len(self.kept) >= _KEPT:
                            self.kept.clear()
                        known = self.kept[number, window] = pattern.best(window)
                    distance, end = known[0], low + known[1]
                    if distance > pattern.errors:
                        continue
                best = (distance, max(0, end - pattern.n - distance if distance else end - pattern.n), end)
                found[number] = min(found.get(number, best), best)
        return [(self.items[n][0], *found[n]) for n in sorted(found)]


_matcher: dict[str, Matcher] = {}


class Part(NamedTuple):
    name: str
    items: Broadcast


def _worker_matcher(part: Part, rate: float) -> Matcher:
    """The automaton of one part, built once a worker; another part takes its place."""
    working("leaks", _matcher.clear)
    if part.name not in _matcher:
        _matcher.clear()
        _matcher[part.name] = Matcher(part.items.value, rate)
    return _matcher[part.name]


def _parts(items: DataFrame) -> Iterator[Part]:
    """The normalised items in broadcast lists of bounded size, one after the other."""
    kept = items.where(F.col("text").isNotNull()).select("item_id", "text")
    size = kept.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    for p in range(parts):
        rows = kept.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).collect()
        rows = sorted(((r["item_id"], normal(r["text"])) for r in rows), key=lambda x: (str(x[0]), x[1]))
        yield Part(uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows))


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start_at and end_at for every document and item found in it."""
    small_batches(docs.sparkSession)
    id_type, item_type = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    item_arrow = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, start_at long, end_at long"

    def search(part: Part) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _worker_matcher(part, rate)
            for batch in batches:
                rows = [(i, *hit) for i, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.find(text)]
                at, item, distance, start, end = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_arrow), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "start_at", "end_at"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return functools.reduce(DataFrame.unionByName, (search(part) for part in _parts(items)))


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    for part in _parts(items):

        def run(batches: Iterator[pa.RecordBatch], part: Part = part) -> Iterator[pa.RecordBatch]:
            matcher = _worker_matcher(part, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
