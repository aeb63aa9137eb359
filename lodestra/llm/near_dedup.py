"""Near-duplicate classes by BagMinHash signatures.

A document is a bag (multiset) of runs of five words; two documents are linked if the weighted Jaccard
similarity of their bags is at least 0.8. A class is a connected component of links.

Signatures. Each term of the bag owns Poisson processes over levels of weight: one on the level [0, 1),
one on [1, 2), [2, 4), [4, 8) and so on, up to its multiplicity. A process yields points of (time,
register, level); points above the multiplicity do not count. Each register keeps its earliest point. Two
bags share a register's point with the probability of their weighted Jaccard similarity. Processes are
followed only until they pass the latest time any register holds, so a text costs about one point a term.

Candidates and links. Equal bags collapse first, by a 128-bit hash, and each distinct bag gets a number.
Signatures are cut into bands; bags that share a band are candidates. In each band every bag is compared
with the band's least and largest one only, by exact multiset overlap: hubs with many partners are salted,
so a hub's bag travels once a salt and its partners' once a pair. Their links give first classes. Only
bands that still hold bags of two classes matter from then on: what hangs together by these forms a
cluster, and there bags of different classes are compared exactly, in pairs of bounded blocks that give
links between classes instead of pairs. A link is lost only if no chain of shared bands joins its ends: at
similarity 0.8, with a probability below (1 - 0.8**6)**42 = 3e-6.

Defined results: a text of fewer than five words has one term, all its words; a text without words (or
null) has the empty bag, equal only to other empty bags. A null doc_id counts as the smallest. Rows count one
by one: rows with one id and different texts are different documents, whose classes class_key tells apart.
Ids may have any type that sorts. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestra.llm.common import Scratch, free_name, partitions, small_batches
from lodestra.llm.components import components
from lodestra.llm.kernels import blocks, mix64, span_hashes, window_hashes, words
from lodestra.llm.workers import working

WIDTH, SIMILARITY, REGISTERS, BANDS = 5, 0.8, 252, 42
BLOCK_TERMS, HUB_PAIRS, GROUP_BYTES = 1 << 18, 256, 4 << 20
_U = np.uint64
_MET = 1 << 20


def bags(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The texts' terms as sorted hashes with repeats, and where each text's terms begin."""
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs, at = window_hashes(hashes, first, width)
    owner = np.searchsorted(first, at, "right") - 1
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        extra = np.array([mix64(np.array([np.bitwise_xor.reduce(mix64(hashes[first[d] : first[d + 1]] + np.arange(1, sizes[d] + 1, dtype=_U)))]))[0] for d in short], _U)
        runs, owner = np.concatenate([runs, extra]), np.concatenate([owner, short])
    order = np.lexsort((runs, owner))
    return runs[order], np.searchsorted(owner[order], np.arange(len(offsets)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(terms: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's earliest point in each register, as 64-bit names, and each text's 128-bit bag hash."""
    n = len(first) - 1
    times, names = np.full((n, registers), np.inf), np.zeros((n, registers), _U)
    print_ = np.zeros((n, 2), _U)
    if len(terms):
        owner = np.repeat(np.arange(n), np.diff(first))
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(terms)))
        term, owner = terms[at], owner[at]
        mixed = mix64(term + count.astype(_U) * _U(0x9E3779B97F4A7C15))
        np.add.at(print_[:, 0], owner, mixed)
        np.add.at(print_[:, 1], owner, mix64(mixed ^ _U(0x5851F42D4C957F2D)))
        # One process for [0, 1), then one for each [2**(k-1), 2**k) that the multiplicity reaches.
        parts, k = [(owner, mix64(term), np.ones(len(term)), np.ones(len(term)))], 1
        more = np.flatnonzero(count > 1)
        while len(more):
            low = 2.0 ** (k - 1)
            parts.append((owner[more], mix64(term[more] ^ mix64(np.array([k], _U))), np.full(len(more), low), np.minimum(count[more] - low, low)))
            k += 1
            more = more[count[more] > 2 ** (k - 1)]
        owner, seed, length, covered = (np.concatenate(x) for x in zip(*parts))
        time, turn = np.zeros(len(owner)), 0
        while len(owner):
            point = mix64(seed + _U((turn * 0xD1342543DE82EF95 + 1) & (2**64 - 1)))
            time = time - np.log(_uniform(point)) / (length * registers)
            where = mix64(point ^ _U(0xA0761D6478BD642F))
            cell = owner * registers + (where % _U(registers)).astype(np.int64)
            ok = time < times.ravel()[cell]
            if k > 1:
                ok &= _uniform(mix64(where)) * length < covered
            c, t, p = cell[ok], time[ok], point[ok]
            np.minimum.at(times.ravel(), c, t)
            won = times.ravel()[c] == t
            names.ravel()[c[won]] = p[won]
            turn += 1
            live = time < times.max(1)[owner]
            owner, seed, length, covered, time = owner[live], seed[live], length[live], covered[live], time[live]
    return names, print_


def band_keys(names: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = names.shape[1] // bands
    keys = np.zeros((len(names), bands), _U) + np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for r in range(rows):
        keys = mix64(keys ^ names[:, r::rows][:, :bands]) + _U(r + 1)
    return keys


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the multiset intersection and union of two sorted arrays."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both, len(a) + len(b) - both


def _rows(docs: DataFrame) -> DataFrame:
    """id, text and the text's 128-bit hash (t1, t2), by which equal rows are known."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _signed(rows: DataFrame, width: int, registers: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                terms, first = bags(data, offsets, width)
                names, prints = signatures(terms, first, registers)
                keys = band_keys(names, bands).astype("<i8")
                n = len(keys)
                # A bag without terms has no band: it equals other empty bags only.
                some = np.diff(first) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
                p = prints.astype("<i8")
                own = [batch.column(i).slice(row, n) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p[:, 0]), pa.array(p[:, 1]), lists], names=["id", "t1", "t2", "p", "q", "bands"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, t1 long, t2 long, p long, q long, bands array<bigint>")


def _bags(texts: DataFrame, width: int) -> DataFrame:
    """u and its bag, as sorted 64-bit terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                terms, first = bags(data, offsets, width)
                raw = [terms[first[i] : first[i + 1]].tobytes() for i in range(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(raw)), pa.array(raw, pa.binary())], names=["u", "bag"])

    return texts.mapInArrow(run, "u long, bag binary")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare_hubs(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        working("near")
        hubs, ids = group["hub"].to_numpy(), group["u"].to_numpy()
        raw = group["bag"].combine_chunks() if isinstance(group["bag"], pa.ChunkedArray) else group["bag"]
        bag = lambda i: np.frombuffer(raw[int(i)].as_buffer(), _U)
        centre = {int(hubs[i]): i for i in np.flatnonzero(hubs == ids)}
        a, b = [], []
        for i in np.flatnonzero(hubs != ids):
            both, all_ = overlap(bag(centre[int(hubs[i])]), bag(i))
            if both >= similarity * all_ - 1e-9:
                a.append(int(hubs[i]))
                b.append(int(ids[i]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    return run


def _linked(pairs: DataFrame, bag: DataFrame, groups: int, similarity: float) -> DataFrame:
    """The pairs(hub, o) whose bags are similar enough, by exact overlap."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("parts"))
    others = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("o"), F.col("parts")).cast("int").alias("salt"), F.col("o").alias("u"))
    centres = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("hub").alias("u"))
    # Many small hubs share a group; the salted parts of a large one lie in different groups.
    placed = others.unionByName(centres).withColumn("g", F.pmod(F.xxhash64("hub", "salt"), F.lit(groups)).cast("int"))
    met = placed.join(bag, "u").select("g", "hub", "u", "bag").groupBy("g")
    return met.applyInArrow(_compare_hubs(similarity), "a long, b long")


def _compare_blocks(similarity: float):
    """In a pair of blocks: links between bags of different classes, one for each bag of the first block and
    class, from exact overlaps with all others by way of an inverted index."""

    def run(group: pa.Table) -> pa.Table:
        working("near")
        ids, labels, asks = group["u"].to_numpy(), group["label"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False)
        bag = [np.frombuffer(x.as_buffer(), _U) for chunk in group["bag"].chunks for x in chunk]
        term, size = np.concatenate(bag), np.array([len(x) for x in bag])
        owner = np.repeat(np.arange(len(ids)), size)
        # A repeated term becomes distinct ones, so that sets overlap as the bags do.
        head = np.ones(len(term), bool)
        head[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
        at = np.arange(len(term))
        turn = at - np.maximum.accumulate(np.where(head, at, 0))
        term = mix64(term + turn.astype(_U) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(term, kind="stable")
        holders = owner[order]
        ranked = term[order]
        low, high = np.searchsorted(ranked, term, "left"), np.searchsorted(ranked, term, "right")
        first = np.concatenate([[0], np.cumsum(size)])
        links: set[tuple[int, int]] = set()
        for d in np.flatnonzero(asks):
            a, n = low[first[d] : first[d + 1]], (high - low)[first[d] : first[d + 1]]
            shared = n > 1
            a, n = a[shared], n[shared]
            if not len(a):
                continue
            both = np.zeros(len(ids), np.int64)
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(n) // _MET)) + 1):
                p, m = a[part], n[part]  # a bounded number of meetings at a time
                both += np.bincount(holders[np.repeat(p - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=len(ids))
            near = np.flatnonzero((both >= similarity * (size + size[d] - both) - 1e-9) & (both > 0) & (labels != labels[d]))
            for k in np.unique(labels[near], return_index=True)[1]:
                links.add((min(ids[d], ids[near[k]]), max(ids[d], ids[near[k]])))
        pairs = sorted(links)
        return pa.table([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], schema=_LINKS)

    return run


def _across(members: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Links between different classes of one cluster. members: u, n (terms), cluster, label.

    A cluster's largest class L needs no comparison with itself, so the others, R, are compared with L and
    with each other. Both are cut into blocks of about BLOCK_TERMS terms by a hash of the number, and each
    pair of blocks is one bounded group. What is written grows with the links, not with the pairs."""
    sizes = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    totals = sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("c", "label", "n")).alias("top"), F.sum("n").alias("n")).where("classes > 1")
    cut = lambda n: F.greatest(F.ceil(n / BLOCK_TERMS), F.lit(1)).cast("int")
    totals = totals.select("cluster", F.col("top.label").alias("large"), cut(F.col("top.n")).alias("nl"), cut(F.col("n") - F.col("top.n")).alias("nr"))
    placed = members.join(totals, "cluster").withColumn("own", F.col("label") != F.col("large"))
    block = F.pmod(F.xxhash64("u"), F.when(F.col("own"), F.col("nr")).otherwise(F.col("nl"))).cast("int")
    placed = placed.withColumn("blk", block)
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = lambda kind, i, j, asks: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), asks.alias("asks"))
    within = F.transform(to("nr"), lambda j: key("r", F.least(F.col("blk"), j), F.greatest(F.col("blk"), j), F.col("blk") <= j))
    against = F.transform(to("nl"), lambda j: key("l", F.col("blk"), j, F.lit(True)))
    asked = F.transform(to("nr"), lambda i: key("l", i, F.col("blk"), F.lit(False)))
    spread = placed.select("u", "label", "cluster", F.explode(F.when(F.col("own"), F.concat(within, against)).otherwise(asked)).alias("x"))
    met = spread.join(bag, "u").select("cluster", "x.kind", "x.i", "x.j", "x.asks", "u", "label", "bag")
    return met.groupBy("cluster", "kind", "i", "j").applyInArrow(_compare_blocks(similarity), "a long, b long")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(u, label) after links(a, b): a link between two bags is one between their classes."""
    merged = links.join(labels.select(F.col("u").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("u").alias("b"), F.col("label").alias("y")), "b")
    roots = components(merged.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("root"))
    return labels.join(roots, "label", "left").select("u", F.coalesce("root", "label").alias("label"))


def near_rows(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """For every document: id, its text's hash t1 and t2, and first, the (id, t1, t2) of the least row of its
    class. The one table that is left in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = _rows(docs)
    signed = scratch.settled(_signed(rows, width, registers, bands))
    # One number and one least row stand for each distinct bag; the numbers are fixed once written.
    stands = signed.groupBy("p", "q").agg(F.min(F.struct("id", "t1", "t2")).alias("least"), F.any_value("bands").alias("bands"))
    stands = scratch.settled(stands.withColumn("u", F.monotonically_increasing_id()))
    banded = stands.select("u", F.explode("bands").alias("k"))
    ends = banded.groupBy("k").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo <> hi")
    tried = banded.join(ends, "k").select("u", F.explode(F.array("lo", "hi")).alias("hub")).where("u <> hub")
    tried = scratch.settled(tried.select("hub", F.col("u").alias("o")).distinct())
    # The bags of all candidates are made once, from the text of one row each.
    wanted = tried.select(F.col("hub").alias("u")).union(tried.select("o")).distinct()
    asked = stands.join(wanted, "u", "left_semi").select("u", F.col("least.id").alias("a_id"), F.col("least.t1").alias("a1"), F.col("least.t2").alias("a2"))
    texts = rows.join(asked, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("t1") == F.col("a1")) & (F.col("t2") == F.col("a2"))).groupBy("u").agg(F.any_value("text").alias("text"))
    bag = scratch.settled(_bags(texts, width))
    bytes_ = bag.agg(F.sum(F.octet_length("bag").cast("long")).alias("n")).first()["n"] or 0
    groups = max(partitions(spark), -(-int(bytes_) // GROUP_BYTES))
    labels = components(scratch.settled(_linked(tried, bag, groups, similarity)))
    labels = scratch.settled(wanted.join(labels.withColumnRenamed("id", "u"), "u", "left").select("u", F.coalesce("label", "u").alias("label")))
    # Bands that hold two classes or more, and what hangs together by them.
    held = stands.join(labels, "u").select("u", "label", F.explode("bands").alias("k"))
    mixed = held.groupBy("k").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("u").alias("m")).where("x <> y").select("k", "m")
    chains = scratch.settled(held.join(mixed, "k").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct())
    clusters = components(chains).select(F.col("id").alias("u"), F.col("label").alias("cluster"))
    sizes = bag.select("u", (F.octet_length("bag") / 8).cast("long").alias("n"))
    members = scratch.settled(clusters.join(labels, "u").join(sizes, "u"))
    more = scratch.settled(_across(members, bag, similarity))
    if not more.isEmpty():
        labels = scratch.settled(_merged(labels, more))
    classes = stands.select("p", "q", "u", "least").join(labels, "u", "left").withColumn("label", F.coalesce("label", "u"))
    firsts = classes.groupBy("label").agg(F.min("least").alias("first"))
    classes = classes.join(firsts, "label").select("p", "q", "first")
    return scratch.done(signed.select("id", "t1", "t2", "p", "q").join(classes, ["p", "q"]).select("id", "t1", "t2", "first"))


def near_classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_key (the hash of the class's first text, which
    tells classes apart where ids repeat or are null), for every document."""
    found = near_rows(docs, width, similarity, registers, bands)
    digits = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"), F.concat(digits("first.t1"), digits("first.t2")).alias("class_key"))


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, registers: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """One row of each class, with all its columns: the one with the least doc_id (null is the smallest), of
    several with one id the one whose text has the least hash, of equal ids and texts the least row as JSON."""
    found = near_rows(docs, width, similarity, registers, bands)
    names = [free_name(docs.columns, n) for n in ("t1", "t2")]
    own = docs.withColumns({names[0]: F.xxhash64("text"), names[1]: F.xxhash64(F.lit(1), "text")})
    mine = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.t1") == F.col("t1")) & (F.col("first.t2") == F.col("t2"))
    stay = found.where(mine).groupBy(F.col("id").alias("xi"), F.col("t1").alias("x1"), F.col("t2").alias("x2")).agg(F.count(F.lit(1)).alias("xn"))
    scratch = Scratch(docs.sparkSession)
    stay = scratch.settled(stay)
    on = lambda s: own["doc_id"].eqNullSafe(s["xi"]) & (own[names[0]] == s["x1"]) & (own[names[1]] == s["x2"])
    once = stay.where("xn = 1")
    kept = own.join(once, on(once), "left_semi").select(*(own[c] for c in docs.columns))
    twice = stay.where("xn > 1")
    if twice.isEmpty():
        return kept
    row = F.struct(*(own[c] for c in docs.columns))
    least = own.join(twice, on(twice)).groupBy(*(twice[c] for c in ("xi", "x1", "x2"))).agg(F.min_by(row, F.to_json(row)).alias("x"))
    return kept.unionByName(least.select("x.*"))
