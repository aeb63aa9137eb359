"""Line dedup, substring dedup and near-dedup against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestra.llm import kernels, line_dedup, near_dedup, substring_dedup
from lodestra.llm.perfect_hash import PerfectHash
from tests.llm.fixtures import documents, got, texts

LOW = -(2**63)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, min_chars, min_docs):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(FOLD)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(LOW if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != (LOW if i is None else i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def brute_words(rows, width):
    order = sorted(rows, key=lambda r: LOW if r[0] is None else r[0])
    least, out = {}, []
    for i, t in order:
        w = WORD.findall(t or "")
        for j in range(len(w) - width + 1):
            least.setdefault(tuple(w[j : j + width]), LOW if i is None else i)
    for i, t in order:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if least[tuple(w[j : j + width])] < (LOW if i is None else i):
                gone[j : j + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def brute_classes(rows):
    bags = []
    for i, t in rows:
        w = WORD.findall(t or "")
        bags.append((LOW if i is None else i, collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])))
    root = {i: i for i, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in bags:
        for b, y in bags:
            both = sum((x & y).values())
            if a < b and (x == y or both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((None if i == LOW else i, None if find(i) == LOW else find(i)) for i, _ in bags), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("min_chars, min_docs", [(40, 5), (1, 2), (10, 3)])
def test_line_dedup(spark, min_chars, min_docs):
    done = line_dedup.line_dedup(documents(spark), min_chars, min_docs)
    assert got(done) == brute_lines(texts(), min_chars, min_docs)


def test_line_dedup_carries_columns_and_repeated_ids(spark):
    rows = [(7, "x" * 50)] * 2 + [(i, "x" * 50 + "\nrest") for i in (1, 2, 3)]
    done = line_dedup.line_dedup(documents(spark, rows), carry=["lang", "n_lines"])
    assert done.columns == ["doc_id", "text", "n_lines_", "n_dropped", "lang", "n_lines"]
    assert {(r[0], r[3]) for r in done.collect()} == {(1, 0), (2, 0), (3, 0), (7, 0)}  # four documents, not five
    rows.append((0, "x" * 50))
    done = line_dedup.line_dedup(documents(spark, rows))
    assert {(r.doc_id, r.text) for r in done.collect()} == {(0, ""), (1, "rest"), (2, "rest"), (3, "rest"), (7, "x" * 50)}


@pytest.mark.parametrize("width", [13, 3])
def test_substring_dedup(spark, width):
    assert got(substring_dedup.substring_dedup(documents(spark), width)) == brute_words(texts(), width)


def test_substring_dedup_when_hashes_collide(spark, monkeypatch):
    """With six-bit hashes nearly all edges collide: verification must still remove no wrong word."""
    true = kernels.window_hashes

    def few(*a):
        h, at = true(*a)
        return (h >> np.uint64(58)) << np.uint64(58), at

    rows = [(i, t) for i, t in texts() if t and len(t) < 3000]
    docs = substring_dedup.read_words(__import__("pyarrow").array([t for _, t in rows]), 13)
    monkeypatch.setattr(substring_dedup, "window_hashes", few)
    weak = substring_dedup.read_words(__import__("pyarrow").array([t for _, t in rows]), 13)
    _, head, edge = np.unique(weak.hashes, return_index=True, return_inverse=True)
    every = np.arange(len(edge))
    ok = substring_dedup.verified(weak, every, weak, head[edge], 13)
    assert not ok.all()
    assert (docs.hashes[every[ok]] == docs.hashes[head[edge][ok]]).all()
    assert (docs.hashes[every[~ok]] != docs.hashes[head[edge][~ok]]).all()


@pytest.mark.parametrize("buckets", [1, 37])
def test_substring_dedup_in_any_buckets(spark, monkeypatch, buckets):
    """Repeated and null ids, and documents whose repeats lie in other buckets, or all in one."""
    rows = texts() + [(3, texts()[0][1]), (None, texts()[2][1]), (None, texts()[2][1])]
    monkeypatch.setattr(substring_dedup, "bucket_count", lambda *a: buckets)
    assert got(substring_dedup.substring_dedup(documents(spark, rows), 5)) == brute_words(rows, 5)


def test_paths_stop_where_nodes_branch(spark):
    """Edges 10..15 of one document repeat 0..5 of another; the node between 2 and 3 has two edges out."""
    S, C = 1 << substring_dedup._WORD, substring_dedup._CODE
    one, many = 7, substring_dedup._SEVERAL
    row = lambda edge, id_, at, before=0, after=0: (id_, edge, at << 2 * C | before << C | after)
    table = lambda rows: spark.createDataFrame(rows, "id long, edge long, at long")
    rows = [row(100 + k, i, at + k, one, many if k == 2 else one) for k in range(6) for i, at in ((1, 0), (2, S + 10))]
    rows += [row(200, 5, 50), row(300, 4, 60), row(300, 4, 70)]  # held once; repeated under one id alone
    met = substring_dedup.repeated_edges(table(rows))
    assert got(substring_dedup.compacted(met), "at") == [(S + 10, 0, 3, True), (S + 13, 3, 3, False)]
    # Different codes from different buckets are several edges as well.
    met = substring_dedup.repeated_edges(table([row(100 + k, d, S * d + k, one, one + (d if k == 1 else 0)) for k in range(4) for d in (0, 1)]))
    assert got(substring_dedup.compacted(met), "at") == [(S, 0, 2, True), (S + 2, 2, 2, False)]


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    r = np.random.default_rng(3)
    many = [" ".join(f"w{x}" for x in r.integers(0, 3, r.integers(0, 60))) for _ in range(60)]
    w = substring_dedup.read_words(pa.array(many, pa.string()), 7, True, True)
    each = dict(zip(w.hashes.tolist(), w.anchors.tolist()))
    assert all(each[h] == a for h, a in zip(w.hashes.tolist(), w.anchors.tolist()))
    assert len(set(each.values())) < len(each)


def test_near_classes(spark):
    rows = [r for r in texts()]
    assert got(near_dedup.near_classes(documents(spark)).select("doc_id", "class_id")) == brute_classes(rows)


def test_near_classes_of_chains_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [(10 + k, " ".join(base[: 100 - 3 * k] + [f"n{j}" for j in range(3 * k)])) for k in range(8)]
    rows = chain + [(10, chain[0][1])] * 2 + [(99, "quite another text of some words")]
    assert sorted(set(got(near_dedup.near_classes(documents(spark, rows)).select("doc_id", "class_id")))) == sorted(set(brute_classes(rows)))


def near_groups(seed: int, groups: int, size: int):
    """Groups of edited copies, with repeated passages, at all similarities from 0.6 on."""
    r = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in r.integers(0, 20_000, n)]
    boiler, out = word(60), []
    for _ in range(groups):
        base = word(140)
        for _ in range(size):
            own = list(base)
            for at in r.integers(0, len(own), r.integers(0, 9)):
                own[at] = word(1)[0]
            out.append(" ".join((boiler if r.random() < 0.5 else []) + own))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("hub, block", [(256, 1 << 18), (3, 500)])
def test_near_classes_of_large_groups(spark, monkeypatch, hub, block):
    """Recall at similarity 0.8 is 1 on groups of near copies, with whole and with salted hubs and blocks."""
    monkeypatch.setattr(near_dedup, "HUB_PAIRS", hub)
    monkeypatch.setattr(near_dedup, "BLOCK_TERMS", block)
    rows = near_groups(1, 4, 60)
    assert got(near_dedup.near_classes(documents(spark, rows)).select("doc_id", "class_id")) == brute_classes(rows)


def test_one_of_each_counts_rows_not_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (5, a), (5, b), (5, b), (None, "x y"), (None, "x y"), (None, None), (7, "")]
    docs = documents(spark, rows).withColumnsRenamed({"source": "t1", "n_lines": "first", "__b": "__id"})
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (5, b), (None, "x y"), (None, None)], key=str)
    text_ids = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert near_dedup.one_of_each(text_ids).count() == 4
    found = near_dedup.near_classes(docs).collect()
    assert len(found) == 8 and len({r.class_key for r in found}) == 4


def test_empty_tables(spark):
    none = documents(spark, []).where("false")
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert near_dedup.near_classes(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3) | st.integers(0, 2**64 - 1), st.integers(0, 3) | st.integers(0, 2**64 - 1)), unique=True, max_size=300))
def test_perfect_hash(keys):
    k = np.array(keys, np.uint64).reshape(-1, 2)
    index = PerfectHash(k)
    assert sorted(index.slots(k).tolist()) == list(range(len(keys)))


def test_keys_that_agree_in_one_word_do_not_add_up(monkeypatch):
    """Keys with one word in common, or with equal folds of their words, keep their own counts; strangers get no answer."""
    keys = np.array([(7, x) for x in range(50)] + [(x, 7) for x in range(50) if x != 7] + [(x ^ 3 * y, y) for x, y in ((9, 100), (9, 101), (9, 102))], np.uint64)
    docs = np.arange(len(keys))
    index = line_dedup.LineIndex(keys, docs, docs * 10)
    hit, last = index.probe(keys, 5)
    assert (hit == (docs >= 5)).all() and last.tolist() == (docs[hit] * 10).tolist()
    strangers = keys + np.uint64(1000)
    assert not index.probe(strangers, 0)[0].any()
    monkeypatch.setattr("lodestra.llm.perfect_hash.LEVELS", 0)
    assert (line_dedup.LineIndex(keys, docs, docs).probe(keys, 5)[0] == (docs >= 5)).all()


def test_line_dedup_in_many_shards(spark):
    rows = texts() + [(None, "x" * 50)] * 9 + [(4, "x" * 50), (5, "x" * 50)]
    done = line_dedup.line_dedup(documents(spark, rows), 5, 3, shard_keys=2)
    assert got(done) == brute_lines(rows, 5, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\x0bé", max_size=30), max_size=8))
def test_words_and_windows(many):
    import pyarrow as pa

    found = []
    for _, data, offsets in kernels.blocks(pa.array(many, pa.string()), 16):
        s, e, first = kernels.words(data, offsets)
        h, at = kernels.window_hashes(kernels.span_hashes(data, s, e), first, 2)
        for d in range(len(offsets) - 1):
            own = [bytes(data[a:b]).decode() for a, b in zip(s[first[d] : first[d + 1]], e[first[d] : first[d + 1]])]
            pairs = h[(at >= first[d]) & (at < first[d + 1])]
            found.append((own, [int(x) for x in pairs]))
    names = {}
    for text, (own, pairs) in zip(many, found):
        assert own == WORD.findall(text)
        for p, q in zip(zip(own, own[1:]), pairs):
            assert names.setdefault(q, p) == p and len(pairs) == max(0, len(own) - 1)


def test_bagminhash_is_unbiased():
    r, error = np.random.default_rng(0), []
    for k in range(80):
        a = r.integers(1000 * k, 1000 * k + 50, 120).astype(np.uint64)
        b = np.concatenate([a[: r.integers(20, 120)], r.integers(1000 * k, 1000 * k + 50, 60).astype(np.uint64)])
        a, b = np.sort(kernels.mix64(a)), np.sort(kernels.mix64(b))
        names, _ = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
        both, every = near_dedup.overlap(a, b)
        error.append((names[0] == names[1]).mean() - both / every)
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.035
