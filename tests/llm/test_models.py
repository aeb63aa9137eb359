"""Fingerprints, tokenizers, matchers, revisits, language and quality models, and the pipeline."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestra.llm import decontamination, fingerprints, language_id, quality_net, queries, revisits, sentencepieces, stages, token_counts
from lodestra.llm.components import components
from lodestra.llm.merge_pairs import NEVER, PairTest
from tests.llm.fixtures import documents, got, texts
from tests.oracle import compare, duck

LOW = -(2**63)
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "don't we'll I'M 'SΣΑΣ ΣΣ", "<|endoftext|>a<|startoftext|><|endoftext|>", "école  \x85\x1c\x1f a​b", "日本語 テキスト 123４５ ½²", "İstanbul ǅ ﬁ ẞ", "😀😀 👩‍👩‍👧 a.b,c;!!",
    "a\x00b\x0bc", "'s't're''ll''", "x" * 5000, "ab " * 3000, " " * 5000 + "q", "́abc ́", "É" * 4095 + "é" + "é foo", "<|endoftext", "▁a▁▁b", "  lead  and trail  ", "\n\n\ttabs\r\n",
]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, small, name):
    assert compare(spark, duck(small), small, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_token_counts_equal_the_library():
    library, mine = Tokenizer.from_file(WORD_BPE), token_counts.Counter(WORD_BPE)
    r = random.Random(1)
    pool = [chr(i) for i in [*range(32, 0x250), *range(0x370, 0x500), *range(0x2000, 0x2070), *range(0x3040, 0x3060)]]
    many = ODD + [t or "" for _, t in texts()] + ["".join(r.choice(pool) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    assert [mine.count(t) for t in many] == [len(e.ids) for e in library.encode_batch(many, add_special_tokens=False)]


def test_token_chunks_compose(monkeypatch):
    mine = token_counts.Counter(WORD_BPE)
    whole = [mine.count(t) for t in ODD]
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(token_counts, "CHUNK_CHARS", size)
        short = [(t, n) for t, n in zip(ODD, whole) if len(t) < 300]
        assert [mine.count(t) for t, _ in short] == [n for _, n in short]


def test_token_caches_may_overflow(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    monkeypatch.setattr(token_counts, "KEPT_STATES", 20)
    mine, library = token_counts.Counter(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    assert [mine.count(t) for t in ODD] == [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_token_counts_query(spark):
    rows = {r.doc_id: r for r in token_counts.token_counts(documents(spark), WORD_BPE, 50).collect()}
    assert rows[1000].n_tokens == rows[1001].n_bytes == 0 and rows[1006].over_limit and not rows[1003].over_limit


def test_pieces_equal_the_library():
    library, mine = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), sentencepieces.PieceModel(PIECE_BPE)
    r = random.Random(2)
    pool = [" "] * 40 + ["▁", "\n"] + [chr(i) for i in [*range(32, 0x250), *range(0x3040, 0x3060), 0x1F600, 0x65E5]] + list("theandingtion") * 20
    many = ODD + [t or "" for _, t in texts()] + ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in many:
        ids = np.frombuffer(mine.encode(t), "<i4")
        assert ids.tolist() == library.encode(t)
        assert mine.decode(ids) == library.decode(ids.tolist())


def test_unigram_viterbi_takes_the_best_sum():
    model = sentencepieces.PieceModel(PIECE_BPE, bpe=False)
    r = random.Random(3)
    letters = [p for p in model.ids if len(p) <= 3 and p.isascii()][:400]
    for _ in range(60):
        t = "".join(r.choice(letters) for _ in range(4))[:9]
        best = [0.0] + [float("-inf")] * len(t)
        for end in range(1, len(t) + 1):
            best[end] = max((best[s] + model.score[model.ids[t[s:end]]] for s in range(end) if t[s:end] in model.ids), default=float("-inf"))
        if best[-1] > float("-inf"):
            assert sum(model.score[i] for i in model.unit(t)) == best[-1]


def test_pieces_round_trip(spark):
    docs = documents(spark)
    coded = sentencepieces.encode_pieces(docs, PIECE_BPE)
    back = {r.doc_id: r.text for r in sentencepieces.decode_pieces(coded, PIECE_BPE).collect()}
    assert back == {i: t or "" for i, t in texts()}
    assert all(r.lossless for r in sentencepieces.round_trip(docs, PIECE_BPE).collect())


def test_pairs_that_merging_leaves_alone():
    """Two tokens with merges ab, abb: 'ab'+'b' would merge, 'b'+'ab' would not."""
    halves, rank = {2: (0, 1), 3: (2, 1)}, {2: 0, 3: 1}
    test = PairTest(lambda t: rank.get(t, -1), halves.__getitem__, lambda a, b: next((rank[t] for t, h in halves.items() if h == (a, b)), NEVER))
    assert not test(2, 1) and not test(0, 1) and test(1, 2) and test(2, 2)


def test_fingerprints(spark):
    rows = texts() + [(1007, "zz yy"), (1007, "aa bb"), (1007, "aa bb"), (1007, "aa bb")]
    text = F.coalesce("text", F.lit(""))
    ordered = documents(spark, rows).select("doc_id", "text").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(text), F.xxhash64(F.lit(1), text))
    found = fingerprints.edited_fingerprints(documents(spark, rows)).collect()
    rows = [tuple(r) for r in ordered.collect()]
    key = lambda i, n, h: (LOW if i is None else i, n, h)
    want = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        want.append(key(i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(key(r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    assert sorted(r.near_next for r in found if r.doc_id == 1007)[-2:] == [1.0, 1.0]  # equal rows follow each other
    by_id = {r.doc_id: r for r in found}
    assert by_id[1008].fingerprint == by_id[135 // 3 * 0 + 1008].fingerprint and by_id[1003].fingerprint == by_id[1004].fingerprint
    assert by_id[1000].fingerprint == "0" * 32 and by_id[1001].near_next == 1.0
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert by_id[0].near_edited == 1 - far(by_id[0].fingerprint, by_id[0].edited_fingerprint) / 128
    assert by_id[0].near_next == 1 - far(by_id[0].fingerprint, by_id[3].fingerprint) / 128
    assert fingerprints.edited_fingerprints(documents(spark, []).where("false")).count() == 0
    alone = fingerprints.edited_fingerprints(documents(spark, [(1, "ab cd ef")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"ab cab c").hexdigest()


def test_fingerprint_votes(spark):
    """The packed lanes count what plain signed votes count, over more terms than one piece holds."""
    t = " ".join(f"w{i % 977}" for i in range(70_000))
    df = spark.createDataFrame([(1, t)], "k int, t string")
    mine = fingerprints.fingerprint_rows(df, ["k"], {"x": "t"}).first()
    terms = fingerprints.with_terms(df, ["k"], {"x": "t"}).select(F.explode_outer("x").alias("h"))
    plain = terms.select(*(F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(64))).first()
    assert mine.x_1 & (2**64 - 1) == sum(1 << b for b in range(64) if plain[b] > 0)


def test_block_tables_find_all(spark):
    r = random.Random(4)
    base = [r.getrandbits(128) for _ in range(40)]
    near = [b ^ sum(1 << k for k in r.sample(range(128), r.randint(1, 9))) for b in base for _ in range(3)]
    text = lambda x: f"{x:032x}"
    df = lambda xs: spark.createDataFrame([(text(x),) for x in xs] + [(None,)], "fingerprint string")
    found = {(x.query, x.fingerprint, x.distance) for x in fingerprints.within(df(base), df(base + near)).collect()}
    assert found == {(text(a), text(b), bin(a ^ b).count("1")) for a in base for b in {*base, *near} if 0 < bin(a ^ b).count("1") <= 6}


def edits(a: str, b: str) -> int:
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_pigeonhole_and_myers():
    r = random.Random(5)
    for _ in range(80):
        items = [(i, decontamination.normal("".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 60))))) for i in range(3)]
        parts = []
        for _, x in items:
            y = list(x)
            for _ in range(r.randint(0, 8)):
                k, how = r.randrange(len(y)), r.random()
                y[k : k + 1] = [] if how < 0.3 else ["y", y[k]] if how < 0.6 else ["z"]
            parts.append("".join(y))
        text = decontamination.normal(" qqq ".join(parts))
        matcher = decontamination.Matcher(items, 0.1)
        want = {i: edits(x, text) for (i, x), (_, p) in zip(items, matcher.items) if edits(x, text) <= p.errors}
        assert {i: d for i, d, _, _ in matcher.find(text)} == want


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, None), (3, ""), (4, "tiny")], "item_id long, text string")
    rows = [(1, "x THE  quick brown\nfox jumps over the lazy dog again y"), (2, "the quick brwn fox jumps over the lazy dog again"), (3, "clean"), (4, None), (5, "a tiny one")]
    docs = documents(spark, rows)
    assert got(decontamination.leaks(docs, items).select("doc_id", "item_id", "distance")) == [(1, 1, 0), (2, 1, 1), (5, 4, 0)]
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
    assert decontamination.leaks(docs, items.where("false")).count() == 0


def test_revisits(spark):
    schema = "record_id long, url string, ts long, revisit boolean, etag string, last_modified long, digest string, headers array<struct<name:string,value:string>>"
    h = lambda **k: [(a.replace("_", "-"), b) for a, b in k.items()]
    rows = [
        (1, "http://www.A.example:80/x/?utm_source=q&b=2&a=1#f", 10, False, '"e1"', 5, "d1", h(Content_Type="t", Date="10", X="1")),
        (2, "https://a.example/x?a=1&b=2", 20, False, '"e2"', None, "d2", h(Content_Type="u", Date="20")),
        (3, "a.example/x?b=2&a=1", 20, True, 'W/"e1"', None, None, h(date="20")),  # a response at the same time is not earlier
        (4, "http://a.example/x?a=1&b=2", 25, True, '"e2"', None, None, h(DATE="25", Content_Type="no", Cache_Control="c")),
        (5, "http://a.example/x?a=1&b=2", 26, True, '"e9"', None, None, None),
        (6, "http://a.example/x?a=1&b=2", 5, True, '"e1"', None, None, h(Date="5")),
        (7, "http://a.example/x?a=1&b=2", 30, True, None, 7, None, h(Date="30")),
        (8, "http://a.example/x?a=1&b=2", 31, True, None, None, "d2", None),
        (9, None, 31, True, None, None, "d2", None),
        (10, "http://a.example/x?a=1&b=2", None, True, None, None, "d2", None),
    ]
    found = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.source_id, r.state) for k, r in found.items()} == {3: (1, "resolved"), 4: (2, "resolved"), 5: (2, "mismatch"), 6: (None, "no_source"), 7: (2, "unvalidated"), 8: (2, "resolved"), 9: (None, "no_source"), 10: (None, "no_source")}
    assert [tuple(x) for x in found[4].headers] == [("Content-Type", "u"), ("DATE", "25"), ("Cache-Control", "c")]
    assert found[3].digest == "d1" and found[5].digest is None
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("rows_a_slice", [3, 100_000])
def test_revisits_of_hot_urls_brute_force(spark, monkeypatch, rows_a_slice):
    """One URL with most of the records, spread over many slices or in one, repeated records, null urls and times."""
    monkeypatch.setattr(revisits, "SLICE_ROWS", rows_a_slice)
    r = random.Random(6)
    schema = "record_id long, url string, ts long, revisit boolean, etag string, last_modified long, digest string, headers array<struct<name:string,value:string>>, slice string"
    rows = [(i, r.choice(["a.example/x"] * 8 + ["b.example", None]), r.choice([r.randrange(40)] * 9 + [None]), r.random() < 0.5, None, None, None, None, "x") for i in range(150)]
    rows += [x for x in rows[:20] if x[3]]
    found = sorted((x.record_id, x.source_id) for x in revisits.resolve(spark.createDataFrame(rows, schema)).select("record_id", "source_id").collect())
    want = []
    for i, u, t, again, *_ in rows:
        if again:
            full = [(y[2], y[0]) for y in rows if not y[3] and u is not None and y[1] == u and t is not None and y[2] is not None and y[2] < t]
            want.append((i, max(full)[1] if full else None))
    assert found == sorted(want, key=lambda x: (x[0], x[1] is not None, x[1] or 0)) or sorted(found, key=str) == sorted(want, key=str)


def test_language_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = queries.op7_language_id(spark, small).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = found.where("held_out and n > 40").collect()
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.collect())


def test_language_mixture_and_odd_texts(spark):
    en, fr = "the house of the king and the queen with water " * 40, "le château du roi et de la reine avec des fleurs " * 40
    model = language_id.fit(documents(spark, []).select("doc_id", "text", "lang").union(spark.createDataFrame([(1, en, "en"), (2, fr, "fr")], "doc_id long, text string, lang string")))
    docs = documents(spark, [(1, en + fr), (2, None), (3, "12 ! 3"), (4, "the"), (5, "x"), (6, (en + fr) * 12), (None, fr)])
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert sorted(found[1].langs) == ["en", "fr"] and abs(sum(found[1].shares) - 1) < 1e-9 and 0.4 < found[1].score < 0.65
    assert sorted(found[6].langs) == ["en", "fr"] and found[None].lang_pred == "fr" and found[4].lang_pred == "en"
    assert found[2].lang_pred == found[3].lang_pred == "und" and found[5].lang_pred in ("en", "fr")
    untrained = language_id.fit(documents(spark, [(1, None)]).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(docs, untrained).collect()} == {"und"}


def test_quality_net(spark, small):
    folder = small.replace("0.001", "0.01")
    found = queries.op8_quality_net(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in found)


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 5000):
        raw = bytes(random.Random(n).randrange(256) for _ in range(n))
        c = quality_net.chunks(raw)
        assert c.shape[1] == quality_net.CHUNK
        windows = {bytes((row[k : k + quality_net.WIDTH] - 1).astype(np.uint8)) for row in c for k in range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE) if row[k : k + quality_net.WIDTH].all()}
        assert all(raw[k : k + quality_net.WIDTH] in windows for k in range(0, n - quality_net.WIDTH + 1, quality_net.STRIDE))


def test_quality_learns_separable_texts():
    net = quality_net.QualityNet.fresh()
    sample = [quality_net.chunks(bytes([65 + (i % 2)] * 300)) for i in range(40)]
    net.learn(sample, np.array([i % 2 for i in range(40)], np.float32))
    p = net.scores([b"A" * 300, b"B" * 300, b"", b"B" * 40_000])
    assert p[0] < 0.2 and p[1] > 0.8 and p[3] > 0.8 and 0 <= p[2] <= 1


def test_quality_gradients(monkeypatch):
    """The gradients of every kind of parameter agree with numeric derivatives of the loss, over texts of one and of
    many chunks, in blocks smaller than a text."""
    net = quality_net.QualityNet.fresh()
    for name in ("embed", "conv", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    r = random.Random(4)
    texts = [quality_net.chunks(bytes(r.randrange(256) for _ in range(n))) for n in (5, 400, 2500, 90)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    monkeypatch.setattr(quality_net, "_BLOCK_CHUNKS", 4)
    g, gs = net.gradients(texts, labels)
    for name in ("embed", "conv", "bias", "out"):
        value = getattr(net, name)
        for at in [np.unravel_index(k, value.shape) for k in np.argsort(-np.abs(g[name]).ravel())[:6]]:
            old, h = value[at], 1e-6
            value[at] = old + h
            up = net.loss(texts, labels)
            value[at] = old - h
            down = net.loss(texts, labels)
            value[at] = old
            assert abs((up - down) / (2 * h) - g[name][at]) < 1e-5 * max(1, abs(g[name][at])), (name, at)
    net.shift += 1e-6
    up = net.loss(texts, labels)
    net.shift -= 2e-6
    assert abs((up - net.loss(texts, labels)) / 2e-6 - gs) < 1e-5


def test_quality_scores_by_plain_loops():
    """Convolution, pooling over all chunks and the logistic unit, by loops over a whole text."""
    net, r = quality_net.QualityNet.fresh(), random.Random(9)
    net.bias += 0.05
    for n in (0, 3, 256, 300, 1500):
        raw = bytes(r.randrange(256) for _ in range(n))
        size, step = quality_net.CHUNK, quality_net.CHUNK - quality_net.WIDTH + quality_net.STRIDE
        tops = []
        for at in range(0, max(1, n - (size - step)), step):
            codes = [b + 1 for b in raw[at : at + size]] + [0] * max(0, size - len(raw[at : at + size]))
            best = [-1e9] * quality_net.FILTERS
            for k in range(0, size - quality_net.WIDTH + 1, quality_net.STRIDE):
                window = [x for c in codes[k : k + quality_net.WIDTH] for x in net.embed[c].tolist()]
                for f in range(quality_net.FILTERS):
                    best[f] = max(best[f], sum(a * b for a, b in zip(window, net.conv[:, f].tolist())))
            tops.append([max(b + c, 0.0) for b, c in zip(best, net.bias.tolist())])
        feats = [max(t[f] for t in tops) for f in range(quality_net.FILTERS)] + [sum(t[f] for t in tops) / len(tops) for f in range(quality_net.FILTERS)]
        want = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(feats, net.out.tolist())) + net.shift)))
        assert abs(net.scores([raw])[0] - want) < 1e-4


def test_quality_of_odd_rows(spark):
    docs = documents(spark, texts() + [(1007, None), (None, "x " * 90_000)])
    net = quality_net.QualityNet.fresh()
    found = quality_net.score(docs, net).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1000, 1001)}) == 1
    assert quality_net.score(docs.where("false"), quality_net.fit(docs.selectExpr("doc_id", "text", "cast(null as int) as label"))).count() == 0


def plain_mixture(logs, bins, rounds):
    """Expectation-maximisation by loops."""
    n = len(logs)
    shares = [1 / n] * n
    for _ in range(rounds):
        new = [0.0] * n
        for b in bins:
            each = [s * np.exp(logs[i][b]) for i, s in enumerate(shares)]
            for i in range(n):
                new[i] += each[i] / sum(each) / len(bins)
        shares = new
    return shares


def test_mixture_by_plain_em_and_all_sets():
    """Shares equal a plain EM's; the chosen set has the best penalised likelihood of all sets with the same rule."""
    import itertools

    r = np.random.default_rng(5)
    names = ["a", "b", "c", "d"]
    counts = r.random((4, language_id.BINS)) ** 6 + 1e-3
    model = language_id.LanguageModel(names, np.log(counts / counts.sum(1, keepdims=True)))
    agreed = 0
    for k in range(12):
        true = sorted(r.choice(4, r.integers(1, 3), replace=False).tolist())
        bins = np.concatenate([r.choice(language_id.BINS, 150, p=np.exp(model.logs[i]) / np.exp(model.logs[i]).sum()) for i in true])
        chosen, shares = model.infer(bins)
        plain = plain_mixture([model.logs[i] for i in chosen], bins, language_id.ROUNDS)
        assert np.allclose(shares, plain if len(chosen) > 1 else [1.0], atol=1e-9)

        def score(subset):
            p = plain_mixture([model.logs[i] for i in subset], bins, language_id.ROUNDS)
            fit = sum(np.log(sum(s * np.exp(model.logs[i][b]) for i, s in zip(subset, p))) for b in bins)
            return fit / language_id.GRAM - 0.5 * np.log(len(bins)) * len(subset)

        best = max((s for n in (1, 2, 3) for s in itertools.combinations(range(4), n)), key=score)
        agreed += sorted(chosen) == list(best)
        assert sorted(chosen) == true
        long = np.tile(bins, 200)  # the form of counts gives the same
        assert long.size > language_id._DIRECT and model.infer(long)[0][0] in chosen
        assert np.allclose(model._mix(np.exp(model.logs[:, bins]), None, len(bins)), plain_mixture(model.logs, bins, language_id.ROUNDS), atol=1e-9)
    assert agreed == 12


def test_numerals_are_no_letters(spark):
    model = language_id.fit(spark.createDataFrame([(1, "the house of the king", "en")], "doc_id long, text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in language_id.identify(documents(spark, [(1, "²"), (2, "½ ③"), (3, "Ⅷ"), (4, "ª"), (5, "日")]), model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en"}


def test_piece_models_are_checked():
    raw = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).serialized_model_proto()
    assert sentencepieces.model_kind(raw) == sentencepieces.BPE
    field = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    plain = bytes([3 << 3, 1, 4 << 3, 0])  # a mark in front, white space kept
    assert sentencepieces.model_kind(field(2, bytes([3 << 3, 1])) + field(3, plain)) == sentencepieces.UNIGRAM
    for trainer, normal in ((bytes([3 << 3, 3]), plain), (b"", plain + field(2, b"map")), (b"", bytes([4 << 3, 1])), (b"", bytes([3 << 3, 0, 4 << 3, 0]))):
        with pytest.raises(ValueError):
            sentencepieces.model_kind(field(2, trainer) + field(3, normal))


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (205, 200), (201, 205), (203, 201)], "a long, b long")
    labels = {r.id: r.label for r in components(links).collect()}
    assert {labels[k] for k in range(31)} == {0} and labels[101] == 100 and labels[203] == labels[205] == 200


def test_pipeline(spark, small):
    """Each stage against its operator's own decision on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, _ in stages.STAGES] and len(corpus_pipeline.STAGES) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stages.written(spark, stage(spark, before, small))
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count()
        before = after
    assert decontamination.leaks(before, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, before, small)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in before.collect())
    assert corpus_pipeline.run(spark, small).count() == before.count()


def test_pipeline_keeps_odd_rows(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    kept = stages.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert stages.lines(spark, docs, "").count() == docs.count()
    assert isinstance(pa.__version__, str)


def test_near_classes_find_edited_copies(spark):
    """Copies at similarity 0.8 of their five-word terms and equal ones are found, with their numbers; all pairs as by brute force."""
    r = random.Random(8)
    base = [[f"w{r.randrange(5000)}" for _ in range(400)] for _ in range(12)]
    edited = [[*w] for w in base]
    for w in edited:
        for at in (50, 120, 190, 260, 330):
            w[at] = "changed"
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w)) for i, w in enumerate(edited)] + [(200, " ".join(base[0]))]
    found = fingerprints.edited_fingerprints(documents(spark, rows)).select("doc_id", "fingerprint").cache()
    near = {x.query: [tuple(y) for y in x.near] for x in fingerprints.near_classes(found.where("doc_id < 12"), found).collect()}
    of = {x.doc_id: x.fingerprint for x in found.collect()}
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    count = lambda f: sum(x == f for x in of.values())
    assert near == {of[i]: sorted((far(of[i], f), f, count(f)) for f in set(of.values()) if far(of[i], f) <= 28) for i in range(12)}
    assert all(of[100 + i] in [f for _, f, _ in near[of[i]]] for i in range(12))
    assert near[of[0]][0] == (0, of[0], 2)
    assert any(far(of[i], of[100 + i]) > fingerprints.RADIUS for i in range(12))


def test_fingerprint_query_returns_the_matching_classes(spark, small):
    found = queries.op1_fingerprints(spark, small)
    asked = found.where("near is not null").collect()
    assert {x.doc_id % 100 for x in asked} == {0} and all(x.near[0].distance == 0 and x.near[0].fingerprint == x.fingerprint and x.n_near == len(x.near) - 1 for x in asked)
    assert found.where("doc_id % 100 <> 0 and n_near is not null").count() == 0
