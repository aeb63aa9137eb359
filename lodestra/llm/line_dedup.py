"""Line dedup over a sharded minimal perfect hash.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased. A key of at
least `min_chars` code points that occurs in at least `min_docs` documents loses its lines in all
documents but the one with the largest doc_id among those that hold it. All other lines stay.

1. Spark counts, for each distinct 128-bit key hash, the documents that hold it and the largest of their ids.
   The rows are (hash, doc_id) pairs, so a line that a third of all documents share is spread by id and
   combined before it meets.
2. The distinct hashes are cut into shards of about SHARD_KEYS. Each shard builds a minimal perfect hash that
   indexes three arrays: fingerprints (both words of the hash), document counts and largest ids.
3. Buckets of documents, even in bytes, send each of their distinct keys once, as a row, to its shard. There the
   keys probe the arrays; a key whose fingerprint agrees and whose count is large enough is answered with its
   largest id. Lines are joined with lines nowhere, and rows grow with the keys, not with buckets times shards.
4. Each bucket meets its answers and drops lines.

Recovery: every step is a Spark stage over shuffle files or over the table of counts in the shared folder.

Defined results: a null or empty text is one empty line and becomes ''. A null doc_id counts as the
smallest id; ids are whole numbers. Rows with one doc_id count as one document; each gives a row of its own.
Other columns pass only if named in `carry`; where one has the name n_lines or n_dropped, the operator's own
column gets an underscore more. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestra.llm.common import bucket_count, free_name, inner_id, outer_id, partitions, settled, small_batches
from lodestra.llm.perfect_hash import PerfectHash
from lodestra.llm.workers import working

MIN_CHARS, MIN_DOCS, SHARD_KEYS = 40, 5, 500_000
_STRIP = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The key's 128-bit hash; None for keys that are too short to matter."""
    key = line.strip(_STRIP)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode().lower())  # bytes.lower() touches A-Z alone


def text_keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for x in (text or "").split("\n") if (k := line_key(x, min_chars)) is not None}


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _held(min_chars: int):
    """Rows (k0, k1, id): each text's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("lines")
        for batch in batches:
            found = [text_keys(t.as_py(), min_chars) for t in batch.column(1)]
            keys = _words([k for one in found for k in one])
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(one) for one in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(ids, pa.int64())], names=["k0", "k1", "__id"])

    return run


def _asked(min_chars: int):
    """Rows (k0, k1, __b): a bucket's distinct keys."""

    def run(group: pa.Table) -> pa.Table:
        working("lines")
        keys = _words(list(set().union(*(text_keys(t.as_py(), min_chars) for t in group["__text"]))))
        bucket = group["__b"][0].as_py()
        return pa.table([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.full(len(keys), bucket, np.int32))], names=["k0", "k1", "__b"])

    return run


class LineIndex:
    """A shard: a perfect hash over the distinct keys and the arrays that it indexes."""

    def __init__(self, keys: np.ndarray, docs: np.ndarray, last: np.ndarray):
        self.slots = PerfectHash(keys)
        at = self.slots.slots(keys)
        self.prints, self.docs, self.last = np.zeros_like(keys), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
        self.prints[at], self.docs[at], self.last[at] = keys, np.minimum(docs, 2**32 - 1), last

    def probe(self, keys: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys at least min_docs documents hold, and the largest id for each of these."""
        at = self.slots.slots(keys)
        hit = (at >= 0) & (self.prints[at] == keys).all(1) & (self.docs[at] >= min_docs) if len(self.docs) else np.zeros(len(keys), bool)
        return hit, self.last[at[hit]]


_ANSWER = pa.schema([("__b", pa.int32()), ("key", pa.binary()), ("last", pa.int64())])


def _pairs(table: pa.Table) -> np.ndarray:
    return np.stack([table["k0"].to_numpy(), table["k1"].to_numpy()], 1).view(np.uint64)


def _probe(min_docs: int):
    def run(counts: pa.Table, asked: pa.Table) -> pa.Table:
        working("lines")
        keys = _pairs(asked)
        hit, last = LineIndex(_pairs(counts), counts["docs"].to_numpy(), counts["last"].to_numpy()).probe(keys, min_docs)
        raw = [k.tobytes() for k in keys[hit].astype("<u8")]
        return pa.table([pa.array(asked["__b"].to_numpy()[hit], pa.int32()), pa.array(raw, pa.binary()), pa.array(last, pa.int64())], schema=_ANSWER)

    return run


def drop_lines(text: str, doc: int, last: dict[bytes, int], min_chars: int) -> tuple[str, int, int]:
    lines = text.split("\n")
    kept = [x for x in lines if (key := line_key(x, min_chars)) is None or last.get(key, doc) <= doc]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _apply(min_chars: int, carry: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        working("lines")
        last = dict(zip(answers["key"].to_pylist(), answers["last"].to_pylist()))
        done = [drop_lines(t.as_py() or "", i, last, min_chars) for i, t in zip(docs["__id"].to_pylist(), docs["__text"])]
        texts, lines, dropped = zip(*done) if done else ((), (), ())
        return pa.table([docs["__id"], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), *(docs[f"__c_{c}"] for c in carry)], names=["__id", "text", "n_lines", "n_dropped", *(f"__c_{c}" for c in carry)])

    return run


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: list[str] | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped and the carried columns."""
    carry = carry or []
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(inner_id().alias("__id"), F.col("text").alias("__text"), *(F.col(c).alias(f"__c_{c}") for c in carry))
    held = rows.select("__id", "__text").mapInArrow(_held(min_chars), "k0 long, k1 long, __id long")
    counts = settled(spark, held.groupBy("k0", "k1").agg(F.count_distinct("__id").alias("docs"), F.max("__id").alias("last")))
    shards = max(partitions(spark), -(-counts.count() // shard_keys))
    shard = F.pmod(F.xxhash64("k0", "k1"), F.lit(shards)).cast("int").alias("__s")
    n = bucket_count(rows, "__text")
    kept = rows.withColumn("__b", F.pmod(F.xxhash64("__id", "__text"), F.lit(n)).cast("int")).repartition("__b")
    asked = kept.groupBy("__b").applyInArrow(_asked(min_chars), "k0 long, k1 long, __b int")
    answers = counts.select("*", shard).groupBy("__s").cogroup(asked.select("*", shard).groupBy("__s")).applyInArrow(_probe(min_docs), "__b int, key binary, last long")
    kinds = "".join(f", `__c_{c}` {dict(docs.dtypes)[c]}" for c in carry)
    done = kept.groupBy("__b").cogroup(answers.groupBy("__b")).applyInArrow(_apply(min_chars, carry), f"__id long, text string, n_lines long, n_dropped long{kinds}")
    own = [F.col(n).alias(free_name(carry, n)) for n in ("n_lines", "n_dropped")]
    return done.select(outer_id("__id").alias("doc_id"), "text", *own, *(F.col(f"__c_{c}").alias(c) for c in carry))
