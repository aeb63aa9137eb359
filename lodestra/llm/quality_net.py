"""A byte-level convolutional network in numpy that scores texts.

The whole text is cut into overlapping chunks. Learned filters run over each chunk's byte embeddings; each
filter's largest response in a chunk is pooled, and a text's largest and mean pooled responses over all
its chunks go through one logistic unit. Filters move by STRIDE bytes, on one grid over the whole text, and chunks
overlap by the filter width, so no window of that grid is lost between chunks.

Training sees at most about `max_docs` labelled rows, chosen by a hash of doc_id: a parameter of the fit. It reads
their texts whole, as scoring does; both work on a bounded number of chunks at a time. Scoring is one pass without a
shuffle.

Defined results: null and empty texts are scored as a text of padding. Rows without a label are not
learned from; a null doc_id counts as held out. Without training rows every score is the untrained one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestra.llm.common import small_batches
from lodestra.llm.workers import working

CHUNK, WIDTH, STRIDE, EMBED, FILTERS = 256, 8, 2, 6, 24
MAX_DOCS, EPOCHS, BATCH, SEED = 3000, 6, 64, 20240101
THRESHOLD = 0.3
_STEP = CHUNK - WIDTH + STRIDE
_PLACES = (CHUNK - WIDTH) // STRIDE + 1
_BLOCK_CHUNKS = 2048
PENALTY = 1e-4


def chunks(raw: bytes) -> np.ndarray:
    """All chunks of a text as rows of CHUNK byte codes (1 to 256; 0 pads the last one)."""
    n = max(1, -(-max(0, len(raw) - (CHUNK - _STEP)) // _STEP))
    padded = np.zeros((n - 1) * _STEP + CHUNK, np.int32)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8).astype(np.int32) + 1
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::_STEP]


@dataclass
class QualityNet:
    embed: np.ndarray  # 257 x EMBED
    conv: np.ndarray  # WIDTH*EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2*FILTERS
    shift: float

    @classmethod
    def fresh(cls) -> QualityNet:
        r = np.random.default_rng(SEED)
        return cls(
            r.normal(0, 0.5, (257, EMBED)).astype(np.float32),
            r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            0.0,
        )

    def windows(self, codes: np.ndarray) -> np.ndarray:
        seen = np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=1)[:, ::STRIDE]
        return self.embed[seen].reshape(len(codes), _PLACES, WIDTH * EMBED)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """The filters' largest responses in each chunk, from per-byte tables of the filters."""
        parts = []
        for i in range(0, len(codes), _BLOCK_CHUNKS):
            w = self.windows(codes[i : i + _BLOCK_CHUNKS])
            parts.append((w.reshape(-1, WIDTH * EMBED) @ self.conv).reshape(-1, _PLACES, FILTERS).max(1))
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts; memory is bounded by a few thousand chunks at a time."""
        out = np.empty(len(texts))
        held: list[np.ndarray] = []
        first, size = 0, 0
        for i, raw in enumerate(texts):
            held.append(chunks(raw))
            size += len(held[-1])
            if size >= _BLOCK_CHUNKS or i + 1 == len(texts):
                top = self.pooled(np.concatenate(held))
                at = np.cumsum([0, *(len(h) for h in held[:-1])])
                feats = np.concatenate([np.maximum.reduceat(top, at), np.add.reduceat(top, at) / np.array([[len(h)] for h in held])], axis=1)
                out[first : i + 1] = 1 / (1 + np.exp(-(feats @ self.out + self.shift).astype(np.float64)))
                held, first, size = [], i + 1, 0
        return out

    def loss(self, texts: list[np.ndarray], labels: np.ndarray) -> float:
        """The mean log loss, with the penalty on `out` that gradients() has."""
        feats = np.stack([self._pools(self.pooled(t)) for t in texts])
        z = feats.astype(np.float64) @ self.out + self.shift
        return float(np.mean(np.logaddexp(0, z) - labels * z) + 0.5 * PENALTY * np.sum(self.out.astype(np.float64) ** 2))

    @staticmethod
    def _pools(top: np.ndarray) -> np.ndarray:
        return np.concatenate([top.max(0), top.mean(0)])

    def _winners(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk (before the bias), and its place."""
        raw = (self.windows(codes).reshape(-1, WIDTH * EMBED) @ self.conv).reshape(len(codes), _PLACES, FILTERS)
        place = raw.argmax(1)
        return np.take_along_axis(raw, place[:, None], 1)[:, 0], place

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of loss(), by full backpropagation through pooling, filters and embeddings: only winning windows count.
        Whole texts, at most _BLOCK_CHUNKS chunks at a time."""
        sizes = np.array([len(t) for t in texts])
        starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
        codes = np.concatenate(texts)
        parts = [self._winners(codes[i : i + _BLOCK_CHUNKS]) for i in range(0, len(codes), _BLOCK_CHUNKS)]
        place = np.concatenate([p for _, p in parts])
        top = np.maximum(np.concatenate([t for t, _ in parts]) + self.bias, 0)
        peak = np.maximum.reduceat(top, starts)
        feats = np.concatenate([peak, np.add.reduceat(top, starts) / sizes[:, None]], 1)
        p = 1 / (1 + np.exp(-(feats @ self.out + self.shift)))
        err = ((p - labels) / len(texts)).astype(self.out.dtype)
        g = {"out": feats.T @ err + PENALTY * self.out}
        d = err[:, None] * self.out
        # Of several chunks with one peak the first takes its gradient.
        best = top == peak[owner]
        seen = np.cumsum(best, 0)
        first = best & (seen - (seen[starts] - best[starts])[owner] == 1)
        dtop = np.where(first, d[owner, :FILTERS], 0) + d[owner, FILTERS:] / sizes[owner, None]
        dtop = np.where(top > 0, dtop, 0).astype(self.out.dtype)
        g["bias"] = dtop.sum(0)
        g["conv"], g["embed"] = np.zeros_like(self.conv), np.zeros_like(self.embed)
        for i in range(0, len(codes), _BLOCK_CHUNKS // 4):
            block = slice(i, i + _BLOCK_CHUNKS // 4)
            at = place[block] * STRIDE  # chunks x filters
            won = codes[block][np.arange(len(at))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            g["conv"] += np.einsum("cfk,cf->kf", self.embed[won].reshape(*at.shape, WIDTH * EMBED), dtop[block], optimize=True)
            dw = (dtop[block][:, :, None] * self.conv.T).reshape(-1, EMBED)
            flat = won.ravel()
            g["embed"] += np.stack([np.bincount(flat, dw[:, e], 257) for e in range(EMBED)], 1).astype(self.embed.dtype)
        return g, float(err.sum())

    def learn(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """Adam on the log loss."""
        r, params = np.random.default_rng(SEED), ["embed", "conv", "bias", "out"]
        base = np.clip(labels.mean(), 0.01, 0.99)
        self.shift = float(np.log(base / (1 - base)))
        moments = {p: (np.zeros_like(getattr(self, p)), np.zeros_like(getattr(self, p))) for p in params}
        m_shift = v_shift = 0.0
        t = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                g, gs = self.gradients([texts[i] for i in rows], labels[rows])
                t += 1
                for name in params:
                    m, v = moments[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.01 * (g[name] ** 2 - v)
                    setattr(self, name, (getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32))
                m_shift += 0.1 * (gs - m_shift)
                v_shift += 0.01 * (gs * gs - v_shift)
                self.shift -= rate * (m_shift / (1 - 0.9**t)) / ((v_shift / (1 - 0.99**t)) ** 0.5 + 1e-7)


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> QualityNet:
    """labelled: doc_id, text and label (0 or 1, null: skipped). The learner gets about max_docs rows."""
    net = QualityNet.fresh()
    usable = labelled.where(F.col("label").isNotNull())
    n = usable.count()
    if not n:
        return net
    small_batches(labelled.sparkSession)
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(place < min(1.0, max_docs / n)).select(F.col("doc_id").cast("string"), "text", F.col("label").cast("int"))

    got = sorted((r["doc_id"] or "", r["text"] or "", r["label"]) for r in sample.collect())
    if got:
        net.learn([chunks(t.encode()).astype(np.int16) for _, t, _ in got], np.array([y for _, _, y in got], np.float32))
    return net


def score(docs: DataFrame, net: QualityNet, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            p = shared.value.scores([(t or "").encode() for t in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
