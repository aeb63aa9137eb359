"""Language identification by mixture inference.

Each learned language is a distribution over hashed byte trigrams of lower-cased text. A document is a
mixture of languages: expectation-maximisation estimates its proportions from the trigrams' likelihoods.
Then languages join a set in the order of their proportions while the likelihood, penalised by half the
log of the trigram count for each further language (times the trigram's length, as neighbours overlap),
improves. The predicted language is the largest of that set; the score is its proportion in the set's mixture.

The model is fitted on at most about `max_docs` labelled documents of each language, taken by a hash of
their ids, so its cost does not grow; the result, one count array for each language, goes to all tasks.
All texts are then scored whole, in one pass without a shuffle; long ones in the form of counts, which gives the
same sums.

Defined results: null texts and texts without a letter (numerals are none) get 'und' with score 0. A null doc_id counts as held
out. Without any training row all texts get 'und'. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestra.llm.common import small_batches
from lodestra.llm.kernels import blocks
from lodestra.llm.workers import working

BINS, GRAM, MAX_DOCS, ROUNDS = 1 << 16, 3, 3000, 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_DIRECT = 1 << 14


def grams(data: np.ndarray) -> np.ndarray:
    """The bin of the trigram that starts at each byte."""
    if len(data) < GRAM:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


@dataclass
class LanguageModel:
    names: list[str]
    logs: np.ndarray  # languages x BINS

    def infer(self, bins: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The selected languages, largest first, and their proportions."""
        weights = None
        if len(bins) > _DIRECT:
            counts = np.bincount(bins, minlength=BINS)
            bins = np.flatnonzero(counts)
            weights = counts[bins].astype(np.float64)
        logs = self.logs[:, bins]
        n = float(len(bins) if weights is None else weights.sum())
        likely = np.exp(logs - logs.max(0))
        shares = self._mix(likely, weights, n)
        order = np.argsort(-shares, kind="stable")
        alone = logs.sum(1) if weights is None else logs @ weights
        base = logs.max(0).sum() if weights is None else logs.max(0) @ weights
        best, single = [int(np.argmax(alone))], np.ones(1)
        top, mixed = float(alone.max()), single
        for k in range(2, len(order) + 1):
            chosen = [int(i) for i in order[:k]]
            part = self._mix(likely[chosen], weights, n)
            each = np.log(part @ likely[chosen])
            fit = float(base + (each.sum() if weights is None else each @ weights))
            # Trigrams overlap, so GRAM neighbours count as one observation.
            if (fit - top) / GRAM <= 0.5 * np.log(n):
                break
            best, mixed, top = chosen, part, fit
        return best, mixed

    @staticmethod
    def _mix(likely: np.ndarray, weights: np.ndarray | None, n: float) -> np.ndarray:
        shares = np.full(len(likely), 1 / len(likely))
        for _ in range(ROUNDS):
            each = 1 / (shares @ likely)
            if weights is not None:
                each *= weights
            shares = shares * (likely @ each) / n
        return shares / shares.sum()


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> LanguageModel:
    """labelled: doc_id, text, lang. Uses about max_docs documents a language, chosen by a hash of doc_id."""
    small_batches(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((0, BINS)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_docs / n))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(place < share[F.col("lang")]).select("lang", "text")

    def count(group: pa.Table) -> pa.Table:
        total = np.zeros(BINS, np.int64)
        for text in group["text"]:
            total += np.bincount(grams(np.frombuffer(text.as_py().lower().encode(), np.uint8)), minlength=BINS)
        return pa.table({"lang": [group["lang"][0].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    rows = sorted((r["lang"], np.frombuffer(bytes(r["counts"]), np.int64)) for r in sample.groupBy("lang").applyInArrow(count, "lang string, counts binary").collect())
    counts = np.array([c for _, c in rows], dtype=np.float64).reshape(len(rows), BINS) + 0.1
    return LanguageModel([lang for lang, _ in rows], np.log(counts / counts.sum(1, keepdims=True)))


def identify(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, langs and shares of every text, and the carried columns."""
    small_batches(docs.sparkSession)
    carry = carry or []
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("languages")
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found: list[tuple[str, float, list[str], list[float]]] = []
            for row, data, offsets in blocks(pa.array([t.lower() for t in texts], pa.string())):
                bins = grams(data)
                for i in range(len(offsets) - 1):
                    own = bins[offsets[i] : max(offsets[i], offsets[i + 1] - GRAM + 1)]
                    if not len(model.names) or not _LETTER.search(texts[row + i]):
                        found.append((UNKNOWN, 0.0, [], []))
                        continue
                    if not len(own):  # a letter or two: one padded trigram
                        own = grams(np.frombuffer((texts[row + i].lower().encode() + b"  ")[:GRAM], np.uint8))
                    chosen, shares = model.infer(own)
                    order = np.argsort(-shares, kind="stable")
                    found.append((model.names[chosen[order[0]]], float(min(1.0, shares[order[0]])), [model.names[chosen[j]] for j in order], [float(shares[j]) for j in order]))
            lang, score, langs, shares = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), *(batch.column(2 + i) for i in range(len(carry)))],
                names=["doc_id", "lang_pred", "score", "langs", "shares", *(f"__c_{c}" for c in carry)],
            )

    schema = f"doc_id {kinds['doc_id']}, lang_pred string, score double, langs array<string>, shares array<double>" + "".join(f", `__c_{c}` {kinds[c]}" for c in carry)
    done = docs.select("doc_id", "text", *(F.col(c).alias(f"__c_{c}") for c in carry)).mapInArrow(run, schema)
    return done
