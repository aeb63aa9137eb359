"""SentencePiece encoding and decoding in one pass over an automaton of all pieces.

An Aho-Corasick automaton over the normal pieces reads a text once. At each position its output links
give every piece that ends there, longest first; each relaxes the position's best path, found so far, from
the position where the piece starts. What "best" means depends on the model:

* unigram models: the largest sum of piece scores, the plain Viterbi rule;
* BPE models, whose scores are only merge ranks: a sum of ranks would not give the library's pieces. A
  path there may be extended only by a piece that forms, with the path's last piece, a pair that merging
  by rank leaves alone. Exactly one piece can extend to each position then, and the path at the end is
  the library's encoding.

Characters that no piece covers fall back to byte pieces and cut the lattice. If no piece has a word
boundary mark behind another character, a text is a row of independent units (boundary marks and what
follows), whose encodings are kept up to a bound.

Defined results: null and empty texts have no pieces and decode to ''. A text that contains the mark
itself (U+2581) decodes with spaces in its place, as the library does. Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from lodestra.llm.common import free_name, small_batches
from lodestra.llm.merge_pairs import NEVER, PairTest
from lodestra.llm.workers import working

MARK = "▁"
KEPT_UNITS = 300_000


UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number and value (a whole number or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def model_kind(raw: bytes) -> int:
    """The model's type, from its file. Only unigram and BPE models whose normaliser leaves characters as they are,
    keeps white space, marks it, and adds one mark in front are encoded here; any other is an error."""
    spec = {k: v for k, v in _fields(raw) if k in (2, 3)}
    trainer, normal = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"a model of type {kind} is neither unigram nor BPE")
    # Fields of the normaliser: 2 character map, 3 mark in front, 4 white space cut, 5 white space marked; of the trainer: 24 mark behind.
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model's normaliser changes texts in a way that is not supported")
    return kind


class PieceModel:
    def __init__(self, path: str, bpe: bool | None = None):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = model_kind(own.serialized_model_proto())
        n = own.get_piece_size()
        pieces = [own.id_to_piece(i) for i in range(n)]
        special = [own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(pieces, special)) if not s}
        self.score = [own.get_score(i) for i in range(n)]
        self.text = pieces
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if own.is_byte(i)}
        self.unknown = own.unk_id()
        self.bpe = kind == BPE if bpe is None else bpe
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        cut = all(MARK not in p[1:] or set(p) == {MARK} for p in self.ids)
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut else r"(?s).+")
        self.split: dict[int, tuple[int, int]] = {}
        # Scores are negated ranks; pieces of one character are not merged from others.
        rank = [-1 if len(p) == 1 else int(-s) for p, s in zip(pieces, self.score)] if self.bpe else []
        self.allowed = PairTest(rank.__getitem__, self.halves, lambda a, b: rank[i] if (i := self.ids.get(pieces[a] + pieces[b], -1)) >= 0 else NEVER)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before
        raw = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) else b" \xe2\x81\x87 " if own.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.length = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def halves(self, piece: int) -> tuple[int, int]:
        """The two pieces whose merge, the last of its merging by rank, makes a piece."""
        known = self.split.get(piece)
        if known is None:
            parts = list(self.text[piece])
            while len(parts) > 2:
                _, i = max((self.score[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids)
                parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
            known = self.split[piece] = self.ids[parts[0]], self.ids[parts[1]]
        return known

    def unit(self, text: str) -> list[int]:
        n = len(text)
        # a piece id, or -1 at the start, -2 behind a character that goes as bytes; no piece reaches into either
        last, back = [-1] * (n + 1), [0] * (n + 1)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        settled, bpe, known, allowed = 0, self.bpe, self.allowed.known, self.allowed
        for at, (length, piece) in self.automaton.iter(text):
            if at > settled:
                for i in range(settled + 1, at + 1):
                    if best[i] is None:
                        best[i], last[i], back[i] = best[i - 1], -2, i - 1
                settled = at
            end, start = at + 1, at + 1 - length
            if bpe:
                if best[end] is None:
                    before = last[start]
                    fits = True if before < 0 else known.get((before, piece))
                    if fits or fits is None and allowed(before, piece):
                        best[end], last[end], back[end] = 0.0, piece, start
            else:
                total = best[start] + self.score[piece]
                if best[end] is None or total > best[end]:
                    best[end], last[end], back[end] = total, piece, start
        for i in range(settled + 1, n + 1):
            if best[i] is None:
                best[i], last[i], back[i] = best[i - 1], -2, i - 1
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.byte.get(b, self.unknown) for b in reversed(text[back[at] : at].encode())] if self.byte else [self.unknown]
            at = back[at]
        return out[::-1]

    def forget(self) -> None:
        self.kept, self.old = {}, {}
        self.split.clear()
        self.allowed.forget()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        kept, out = self.kept, []
        for unit in self.units.findall(MARK + text.replace(" ", MARK)):
            ids = kept.get(unit)
            if ids is None:
                if len(kept) >= KEPT_UNITS:
                    self.old, self.kept = kept, {}
                    kept = self.kept
                ids = self.old.get(unit)
                if ids is None:
                    ids = np.array(self.unit(unit), "<i4").tobytes()
                if len(unit) <= 64:
                    kept[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        text = self.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and pieces: the piece ids of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        working("pieces", model.forget)
        for batch in batches:
            codes = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(codes), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, pieces array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from what encode_pieces() gives; a null list decodes to ''."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        working("pieces", model.forget)
        for batch in batches:
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str, keep_pieces: bool = False, keep_columns: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id (or, if asked for, all columns of docs), n_pieces,
    pieces_sha256 (of the 32-bit little-endian ids), decoded_sha256 (lowercase hex, UTF-8), lossless (the
    decoded text is the text) and, if asked for, pieces. Where a kept column has one of these names, the new
    column gets an underscore more."""
    small_batches(docs.sparkSession)
    given = docs if keep_columns else docs.select("doc_id")
    n = len(given.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        working("pieces", model.forget)
        for batch in batches:
            texts = [t or "" for t in batch.column(n).to_pylist()]
            codes = [model.encode(t) for t in texts]
            ids = [np.frombuffer(c, "<i4") for c in codes]
            back = [model.decode(i) for i in ids]
            made = [
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
            ]
            if keep_pieces:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4"), pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=schema.fieldNames())

    new = [("n_pieces", "long"), ("pieces_sha256", "string"), ("decoded_sha256", "string"), ("lossless", "boolean"), *([("pieces", ArrayType(IntegerType()))] if keep_pieces else [])]
    schema = StructType(list(given.schema.fields))
    for name, kind in new:
        schema = schema.add(free_name(given.columns, name), kind)
    return docs.select(*(docs[c] for c in given.columns), F.col("text").alias(free_name(given.columns, "__text"))).mapInArrow(run, schema)
