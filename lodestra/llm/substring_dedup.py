"""Exact substring dedup over a de Bruijn graph of word windows.

A window is `width` consecutive words of one document: an edge of the graph whose nodes are runs of
width - 1 words. A word goes if a window that covers it also starts in a document with a smaller doc_id.

Documents lie in buckets, even in bytes, by a hash of id and text; a word's coordinate is its bucket and its
place there. What a bucket says about an edge, it says once, however often it holds it.

1. Anchors. An edge's anchor is the least hash of the short word runs in it, so equal edges have equal
   anchors. Buckets send their distinct anchors; an edge whose anchor lies in one bucket alone can only be
   repeated inside that bucket, and goes no further.
2. Edges. All others become rows: hash, least id and coordinate in the bucket, and codes of the edges before
   and after it. Where an edge's rows meet, the least (id, coordinate) is its source, and several different
   edges before or after it mean that the node at that end has more than one edge in or out.
3. Compaction. Edges that follow each other in a document, and whose sources do so too, form a path as long
   as no node between them branches: neighbours on a nonbranching path follow each other in every document
   that holds both, so their sources have consecutive coordinates. A path is one row from here on.
4. Verification. Each distinct path fetches its words from its source bucket once; a join gives them to all the
   paths' occurrences, paths that go on into each other make one long span again, and each bucket compares
   it with its own words, byte by byte. Repeats inside a bucket are compared there. Covered words go.

So no word is removed on the strength of a hash; one could only be missed where two windows with equal
64-bit hashes have different words. Rows grow with the words: nothing is dealt to all buckets, nothing goes
through the driver but two counts, and an edge or path has at most one row a bucket, however many documents hold it.

Defined results: a null text has no words. A null doc_id counts as the smallest; ids are whole numbers. Rows with
equal ids are no reason to remove words from each other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestra.llm.common import bucket_count, inner_id, outer_id, small_batches
from lodestra.llm.kernels import blocks, span_hashes, window_hashes, window_starts, words
from lodestra.llm.workers import working

WIDTH, ANCHOR_WORDS = 13, 5
_COMPARED = 1 << 18
#: A place is a bucket and a word of it; below it stand the codes of the edges before and after (_CODE bits each).
_WORD, _CODE = 26, 6
_SEVERAL = (1 << _CODE) - 1
_U = np.uint64


@dataclass
class Words:
    """Texts as words: their bytes, each text's first word, the windows' hashes, first words, texts and anchors."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    text: np.ndarray
    anchors: np.ndarray


def least_runs(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each word, the least hash of the short runs among the `width` words that begin there (for words
    that begin a window; of no meaning for others)."""
    short = min(ANCHOR_WORDS, width)
    runs, at = window_hashes(hashes, first, short)
    least = np.full(len(hashes), 2**64 - 1, _U)
    least[at] = runs
    seen, want = 1, width - short + 1
    while seen < want:
        step = min(seen, want - seen)
        least[:-step] = np.minimum(least[:-step], least[step:])
        seen += step
    return least


def read_words(texts: pa.Array, width: int, hashed: bool = True, anchored: bool = False) -> Words:
    """hashed and anchored: whether the windows' hashes and anchors are wanted; without, they are empty."""
    data, starts, ends, first, hashes, at, anchors = [], [], [], [np.zeros(1, np.int64)], [], [], []
    n_bytes = n_words = 0
    for _, raw, offsets in blocks(texts):
        s, e, f = words(raw, offsets)
        each = span_hashes(raw, s, e)
        h, a = window_hashes(each, f, width) if hashed else (np.zeros(0, _U), window_starts(f, width))
        data.append(raw)
        starts.append(s + n_bytes)
        ends.append(e + n_bytes)
        first.append(f[1:] + n_words)
        hashes.append(h)
        at.append(a + n_words)
        if anchored:
            anchors.append(least_runs(each, f, width)[a])
        n_bytes, n_words = n_bytes + len(raw), n_words + len(s)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    first_, at_ = np.concatenate(first), join(at, np.int64)
    return Words(join(data, np.uint8), join(starts, np.int64), join(ends, np.int64), first_, join(hashes, _U), at_, np.searchsorted(first_, at_, "right") - 1, join(anchors, _U))


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """For each pair of word indices: are the words' bytes the same?"""
    size = a.ends[i] - a.starts[i]
    ok = size == b.ends[j] - b.starts[j]
    live = np.flatnonzero(ok)
    for part in np.split(live, range(_COMPARED, len(live), _COMPARED)):  # words at a time, for bounded memory
        if len(part):
            n = size[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = a.data[np.repeat(a.starts[i[part]], n) + step] != b.data[np.repeat(b.starts[j[part]], n) + step]
            ok[part] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return ok


def verified(a: Words, windows: np.ndarray, b: Words, sources: np.ndarray, width: int) -> np.ndarray:
    """Which windows of a (indices) are word for word the given windows of b. Consecutive windows with
    consecutive sources are one span, and each of its words is compared once."""
    if not len(windows):
        return np.zeros(0, bool)
    i, j = a.at[windows], b.at[sources]
    cut = np.ones(len(i), bool)
    cut[1:] = (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(a.text[windows]) != 0) | (np.diff(b.text[sources]) != 0)
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(i))) + width - 1
    base = np.cumsum(length) - length
    step = np.arange(length.sum()) - np.repeat(base, length)
    wrong = ~same_words(a, np.repeat(i[begin], length) + step, b, np.repeat(j[begin], length) + step)
    sums = np.concatenate([[0], np.cumsum(wrong)])
    span = np.cumsum(cut) - 1
    start = base[span] + (np.arange(len(i)) - begin[span])
    return sums[start + width] == sums[start]


def _sorted(group: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts in one order on every run."""
    order = pa.compute.sort_indices(group.select(["__id", "__text"]), [("__id", "ascending"), ("__text", "ascending")])
    texts = pa.chunked_array([group["__text"].cast(pa.large_string()).combine_chunks()]).take(order).combine_chunks()
    return group["__id"].take(order).to_numpy(), texts


def _base(bucket: int, n_words: int) -> int:
    """The coordinate of a bucket's first word."""
    if bucket >> _WORD - 1 or n_words >> _WORD:
        raise ValueError("too many buckets, or too many words in one")
    return int(bucket) << _WORD


def _send_anchors(width: int):
    def run(group: pa.Table) -> pa.Table:
        working("substrings")
        anchors = np.unique(read_words(_sorted(group)[1], width, False, True).anchors).view(np.int64)
        return pa.table({"anchor": anchors, "__b": np.full(len(anchors), group["__b"][0].as_py(), np.int32)})

    return run


def neighbours(w: Words, edge: np.ndarray, met: np.ndarray, step: int) -> np.ndarray:
    """For each distinct edge a code of the edges before it (step -1) or after it (1) that may be repeated
    (met, by edge): 0 for none, _SEVERAL for several, else some bits of the only one's hash."""
    code, n = np.zeros(len(edge), np.int64), len(met)
    near = np.flatnonzero(w.text[1:] == w.text[:-1])
    here, there = (near + 1, near) if step < 0 else (near, near + 1)
    here, there = (x[met[edge[there]]] for x in (here, there))
    code[here] = 1 + (w.hashes[there] >> _U(56)).astype(np.int64) % (_SEVERAL - 1)
    most, least = np.zeros(n, np.int64), np.full(n, _SEVERAL, np.int64)
    np.maximum.at(most, edge, code)
    np.minimum.at(least, edge, np.where(code > 0, code, _SEVERAL))
    return np.where((most > 0) & (least < most), _SEVERAL, most)


def _send_edges(width: int):
    def run(docs: pa.Table, met: pa.Table) -> pa.Table:
        working("substrings")
        out = {k: np.zeros(0, np.int64) for k in ("id", "edge", "at")}
        if docs.num_rows and met.num_rows:
            ids, texts = _sorted(docs)
            w = read_words(texts, width, True, True)
            edges, head, edge = np.unique(w.hashes, return_index=True, return_inverse=True)
            asked = np.sort(met["anchor"].to_numpy().view(_U))
            anchor = w.anchors[head]
            go = asked[np.minimum(np.searchsorted(asked, anchor), len(asked) - 1)] == anchor
            near = neighbours(w, edge, go, -1) << _CODE | neighbours(w, edge, go, 1)
            # In the order of the text, and with what varies side by side, rows pack well.
            go = np.flatnonzero(go)
            go = go[np.argsort(head[go])]
            at = w.at[head[go]] + _base(docs["__b"][0].as_py(), len(w.starts))
            out = {"id": ids[w.text[head[go]]], "edge": edges[go].view(np.int64), "at": at << 2 * _CODE | near[go]}
        return pa.table(out)

    return run


def _send_paths(width: int):
    """Each path's words, from its source bucket: those its edges begin with, and the rest of the last one,
    if no other path goes on from there."""

    def run(docs: pa.Table, paths: pa.Table) -> pa.Table:
        working("substrings")
        spans: list[bytes] = []
        if docs.num_rows and paths.num_rows:
            starts, ends, data = [], [], []
            size = 0
            for _, raw, offsets in blocks(_sorted(docs)[1]):
                s, e, _ = words(raw, offsets)
                starts.append(s + size)
                ends.append(e + size)
                data.append(raw)
                size += len(raw)
            start, end, data = np.concatenate(starts), np.concatenate(ends), np.concatenate(data)
            at = paths["source"].to_numpy() - _base(docs["__b"][0].as_py(), len(start))
            last = at + paths["n"].to_numpy() - 1 + np.where(paths["goes_on"].to_numpy(zero_copy_only=False), 0, width - 1)
            spans = [data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[last].tolist())]
        else:
            paths = paths.slice(0, 0)
        return pa.table([paths["source"], paths["n"], paths["goes_on"], pa.array(spans, pa.binary())], names=["source", "n", "goes_on", "words"])

    return run


def removed(ids: np.ndarray, w: Words, base: int, facts: pa.Table, width: int) -> np.ndarray:
    """The words of a bucket that go. facts: at, goes_on and words of the paths whose sources have smaller ids."""
    edges, head, edge = np.unique(w.hashes, return_index=True, return_inverse=True)
    window = np.full(len(w.starts) + 1, -1, np.int64)
    window[w.at] = np.arange(len(w.at))
    elsewhere = np.zeros(len(edges), bool)
    if facts.num_rows:
        # Paths that go on into each other are one text again, of as many windows as they have edges.
        facts = facts.sort_by("at")
        begins = np.concatenate([[True], ~facts["goes_on"].to_numpy(zero_copy_only=False)[:-1]])
        cut = np.append(np.flatnonzero(begins), facts.num_rows)
        each = [x.as_py() for x in facts["words"]]
        walks = [b" ".join(each[i:j]).decode() for i, j in zip(cut.tolist(), cut[1:].tolist())]
        source = read_words(pa.array(walks, pa.large_string()), width)
        n = np.diff(np.searchsorted(source.text, np.arange(len(walks) + 1)))
        at = facts["at"].to_numpy()[begins] - base
        mine = np.repeat(window[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = verified(w, mine, source, np.arange(len(source.at)), width)
        elsewhere[edge[mine[same]]] = True
    every = np.arange(len(edge))
    first = head[edge]
    copies = np.flatnonzero(first != every)
    alike = np.ones(len(every), bool)
    alike[copies] = verified(w, copies, w, first[copies], width)
    gone = alike & (elsewhere[edge] | (ids[w.text] > ids[w.text[first]]))
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, w.at[gone], 1)
    np.add.at(cover, w.at[gone] + width, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(width: int, with_text: bool):
    def run(docs: pa.Table, facts: pa.Table) -> pa.Table:
        working("substrings")
        ids, texts = _sorted(docs)
        w = read_words(texts, width)
        gone = removed(ids, w, _base(docs["__b"][0].as_py(), len(w.starts)) if docs.num_rows else 0, facts, width)
        sums = np.concatenate([[0], np.cumsum(gone)])
        lost = sums[w.first[1:]] - sums[w.first[:-1]]
        kept = []
        for i, text in enumerate(texts):
            own = (text.as_py() or "").encode().split()
            if lost[i]:
                own = [x for x, g in zip(own, gone[w.first[i] : w.first[i + 1]].tolist()) if not g]
            kept.append(b" ".join(own))
        columns = {"__id": ids, "n_words": np.diff(w.first), "n_removed": lost, "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        return pa.table(columns | ({"text": pa.array([k.decode() for k in kept], pa.string())} if with_text else {}))

    return run


def repeated_edges(edges: DataFrame) -> DataFrame:
    """From rows id, edge and at (a place above two codes): at and shift (the way back to the source's place) of
    the edges whose source has a smaller id, and forks: 2 if the node before branches, 1 if the one after."""
    same = Window.partitionBy("edge")
    source = F.min(F.struct("id", "at")).over(same)

    def forks(code: Column) -> Column:
        return F.coalesce((F.max(code).over(same) == _SEVERAL) | (F.min(F.when(code > 0, code)).over(same) != F.max(code).over(same)), F.lit(False)).cast("long")

    before, after = (F.shiftright("at", n).bitwiseAND(F.lit(_SEVERAL)) for n in (_CODE, 0))
    # Dealt out before the window's own columns are made, so that three longs a row travel.
    met = edges.repartition("edge").select("id", "at", source.alias("s"), (forks(before) * 2 + forks(after)).alias("forks")).where(F.col("s.id") < F.col("id"))
    place = lambda c: F.shiftright(c, 2 * _CODE)
    return met.select(place("at").alias("at"), (place("at") - place("s.at")).alias("shift"), "forks")


def compacted(met: DataFrame) -> DataFrame:
    """at, source and n of the paths: runs of edges whose own and source coordinates are consecutive, up to the
    nodes that branch; goes_on if another path follows there on the same line."""
    line = Window.partitionBy("shift").orderBy("x")
    at, forks = F.shiftright("x", 2), F.col("x").bitwiseAND(F.lit(3))
    last = F.lag("x").over(line)
    begins = F.coalesce((F.shiftright(last, 2) + 1 != at) | (forks >= 2) | (last.bitwiseAND(F.lit(1)) == 1), F.lit(True))
    # Two longs a row: the place and the forks share one.
    rows = met.select("shift", F.shiftleft("at", 2).bitwiseOR(F.col("forks")).alias("x"))
    runs = rows.select("shift", at.alias("at"), "x", begins.alias("begins")).select("shift", "at", F.sum(F.col("begins").cast("int")).over(line).alias("run"))
    runs = runs.groupBy("shift", "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).cast("int").alias("n"))
    after = F.lead("at").over(Window.partitionBy("shift").orderBy("at"))
    return runs.select("at", (F.col("at") - F.col("shift")).alias("source"), "n", F.coalesce(after == F.col("at") + F.col("n"), F.lit(False)).alias("goes_on"))


def substring_dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (lowercase hex of the kept words, joined by one space) and,
    if asked for, text (the kept words)."""
    if width < 2:
        raise ValueError("a window has at least two words")
    small_batches(docs.sparkSession)
    rows = docs.select(inner_id().alias("__id"), F.col("text").alias("__text"))
    n = bucket_count(rows, "__text")
    kept = rows.withColumn("__b", F.pmod(F.xxhash64("__id", "__text"), F.lit(n)).cast("int")).repartition("__b")
    buckets = kept.groupBy("__b")
    anchors = buckets.applyInArrow(_send_anchors(width), "anchor long, __b int")
    same = Window.partitionBy("anchor")
    met = anchors.withColumn("many", F.min("__b").over(same) != F.max("__b").over(same)).where("many").select("anchor", "__b")
    edges = buckets.cogroup(met.groupBy("__b")).applyInArrow(_send_edges(width), "id long, edge long, at long")
    paths = compacted(repeated_edges(edges))
    bucket = lambda c: F.shiftright(c, _WORD).cast("int").alias("__b")
    path = ["source", "n", "goes_on"]
    spans = paths.select(*path).distinct().select(*path, bucket("source"))
    spans = buckets.cogroup(spans.groupBy("__b")).applyInArrow(_send_paths(width), "source long, n int, goes_on boolean, words binary")
    facts = paths.join(spans, path).select("at", "goes_on", "words", bucket("at"))
    schema = "__id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    done = buckets.cogroup(facts.groupBy("__b")).applyInArrow(_finish(width, with_text), schema)
    return done.select(outer_id("__id").alias("doc_id"), *(c for c in done.columns if c != "__id"))
