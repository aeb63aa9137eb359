"""Token counts by a compiled tokenizer.

A BPE vocabulary becomes a deterministic transducer. Its input is the bytes of one word, the last byte in
its end-of-word form; each transition carries the number of tokens by which the encoding of the word so
far grows or shrinks. It rests on a property of BPE: of all tokens that end at a position, exactly one is
the last token of the prefix's encoding, the one whose predecessor forms with it a pair that BPE leaves
alone. So a state need only hold the place in the automaton of all tokens (Aho-Corasick), and for each
start that a later token may have, the last token there and its relative count.

Compilation. The driver builds the automaton and all states and transitions of words that begin some token, and
sends them to the workers. Words that leave the vocabulary's prefixes reach further states, whose number has no
useful bound; these are added on first use and kept up to a bound, as are the counts of whole words.

Chunks. A text is normalised whole and cut into chunks. Between words the machine is a small one over characters (in
letters, in other signs, behind an apostrophe), whose state also holds the transducer's: a Place. A chunk's state map
from entry place to exit place and count is constant from the chunk's first white space on, so it is kept as the
characters before that (its dependence on the entry), a count, and the exit place. Maps compose associatively: the
exit place of one runs over the head of the next. A text's count comes from a pairwise (parallel prefix) scan over
its chunks' maps, whatever its length.

Defined results: null and empty texts have 0 tokens and 0 bytes. The added tokens of the file are matched
inside texts before normalisation, as the library does by default, and count 1 each. Repeated rows give
repeated rows; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import pickle
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lodestra.llm.common import small_batches
from lodestra.llm.merge_pairs import NEVER, PairTest
from lodestra.llm.workers import working

CHUNK_CHARS = 4096
LIMIT_TOKENS = 2048
KEPT_WORDS, KEPT_STATES = 500_000, 250_000
_START, _NONE = -1, (NEVER, -1)
#: Fixed value: the split pattern that step() is built for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Words to token counts. A symbol is chr(byte) inside a word and chr(256 + byte) at its end."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        plain = byte_alphabet()

        def symbols(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            body = [chr(plain[c]) for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                body[-1] = chr(256 + ord(body[-1]))
            return "".join(body)

        self.ids = {symbols(t): i for t, i in vocab.items()}
        self.text = {i: s for s, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = symbols(a), symbols(b)
            if a + b in self.ids:
                self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.made = {t: (rank, pair) for pair, (rank, t) in reversed(self.merges.items())}
        self.allowed = PairTest(self._rank, self._halves, self._joined)
        self._automaton()
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}  # the generation before
        self._compile()

    def _rank(self, token: int) -> int:
        return self.made[token][0] if token in self.made else -1

    def _halves(self, token: int) -> tuple[int, int]:
        return self.made[token][1]

    def _joined(self, a: int, b: int) -> int:
        return self.merges.get((a, b), _NONE)[0]

    def _automaton(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for text, i in self.ids.items():
            node = 0
            for c in text:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for c, to in self.next[node].items():
                queue.append(to)
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
            # the nearest shorter token that ends here too
            back = self.fail[node]
            self.output[node] = back if self.token[back] >= 0 else self.output[back]

    def _compile(self) -> None:
        """The states and transitions of all words that begin a token. The last symbol of a word leads nowhere."""
        first = (0, (_START,), (0,))
        self.states, self.defined, self.moves = {first: 0}, [first], [{}]
        at = 0
        while at < len(self.defined):
            node, last, _ = self.defined[at]
            for symbol in self.next[node] if len(last) == self.depth[node] + 1 else ():
                self.move(at, symbol)
            at += 1
        self.compiled = len(self.defined)

    def forget(self) -> None:
        """Back to the compiled states."""
        n = self.compiled
        del self.defined[n:], self.moves[n:]
        self.states = {key: state for key, state in self.states.items() if state < n}
        self.moves = [{c: m for c, m in moves.items() if m[0] < n} for moves in self.moves]

    def bound(self) -> None:
        """Called between texts."""
        if len(self.defined) - self.compiled >= KEPT_STATES:
            self.forget()

    def move(self, state: int, symbol: str) -> tuple[int, int]:
        node, last, counts = self.defined[state]
        while node and symbol not in self.next[node]:
            node = self.fail[node]
        node = self.next[node].get(symbol, 0)
        at = node if self.token[node] >= 0 else self.output[node]
        while at:
            token, start = self.token[at], len(last) - self.depth[at]
            if last[start] == _START or self.allowed(last[start], token):
                break
            at = self.output[at]
        else:
            raise ValueError(f"no token of the vocabulary ends with {symbol!r}")
        grown = counts[start] + 1
        keep = self.depth[node] + 1
        if symbol >= "\u0100":  # the end of a word
            self.moves[state][symbol] = 0, grown
            return 0, grown
        key = (node, (*last, token)[-keep:], tuple(c - grown for c in (*counts, grown)[-keep:]))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.defined)
            self.defined.append(key)
            self.moves.append({})
        self.moves[state][symbol] = to, grown
        return to, grown

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        total, moves = 0, self.moves
        for c in symbols:
            state, grown = moves[state].get(c) or self.move(state, c)
            total += grown
        return state, total

    def count(self, word: str) -> int:
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= KEPT_WORDS:
                self.old, self.words = self.words, {}
            known = self.old.get(word)
            known = self.words[word] = self.ended(0, word) if known is None else known
        return known

    def ended(self, state: int, rest: str) -> int:
        """What a word's last characters, one or more, add to the count from a state on."""
        symbols = rest.encode().decode("latin-1")
        return self.run(state, symbols[:-1] + chr(256 + ord(symbols[-1])))[1]


class Place(NamedTuple):
    """Where the machine stands in a text: the kind of word it is in ('' for none, 'L' letters, 'O' other signs, "'"
    and what follows it so far), the transducer's state, and the last character, which may end the word."""

    kind: str
    state: int
    last: str


_BETWEEN = Place("", 0, "")
#: The word endings that stand alone behind an apostrophe.
_CLIPS = ("s", "t", "re", "ve", "m", "ll", "d")


class Counter:
    """Counts of whole texts for a tokenizer file: normalise, split, transduce, compose."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["use_regex"] or split["pattern"]["Regex"] != _SPLIT:
            raise ValueError(f"{path} is not a lower-casing word BPE")
        self.machine = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.space, self.letter, self.digit = (regex.compile(x) for x in (r"\p{White_Space}", r"\p{L}", r"\p{N}"))
        self.kinds: dict[str, str] = {}
        added = [x["content"] for x in spec["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def pieces(self, text: str) -> int:
        """The tokens of normalised text without white space at a cut: its words' counts."""
        count = self.machine.count
        return sum(map(count, self.pattern.findall(text)))

    def _kind(self, c: str) -> str:
        known = self.kinds.get(c)
        if known is None:
            known = self.kinds[c] = "" if self.space.match(c) else "L" if self.letter.match(c) else "N" if self.digit.match(c) else "O"
        return known

    def step(self, place: Place, c: str) -> tuple[Place, int]:
        """The machine's transition on one character, with the tokens it emits."""
        machine, kind = self.machine, self._kind(c)
        if place.kind[:1] == "'":
            clip = place.kind[1:] + c
            if clip in _CLIPS:
                return _BETWEEN, machine.count("'" + clip)
            if any(x.startswith(clip) for x in _CLIPS):
                return Place("'" + clip, 0, ""), 0
            # No clip: the apostrophe is a sign, and what came behind it begins a word of letters.
            if place.kind == "'" and kind == "O":
                return Place("O", machine.run(0, "'")[0], c), machine.run(0, "'")[1]
            to, n = (_BETWEEN, 0) if place.kind == "'" else (Place("L", 0, place.kind[1:]), 0)
            after, more = self.step(to, c)
            return after, machine.count("'") + n + more
        if kind == place.kind and kind in ("L", "O"):
            state, n = machine.run(place.state, place.last.encode().decode("latin-1"))
            return Place(kind, state, c), n
        n = self.finish(place)
        if kind == "":
            return _BETWEEN, n
        if kind == "N":
            return _BETWEEN, n + machine.count(c)
        return Place("'" if c == "'" else kind, 0, "" if c == "'" else c), n

    def finish(self, place: Place) -> int:
        """What the end of the text adds to the count."""
        if place.kind[:1] == "'":
            return self.machine.count("'") + (self.machine.count(place.kind[1:]) if place.kind[1:] else 0)
        return self.machine.ended(place.state, place.last) if place.last else 0

    def walk(self, place: Place, text: str) -> tuple[Place, int]:
        total = 0
        for c in text:
            place, n = self.step(place, c)
            total += n
        return place, total

    def chunk_map(self, chunk: str) -> tuple[str, int, Place | None]:
        """(head, count, exit): the exit is None where the chunk has no white space and is all head."""
        first = self.space.search(chunk)
        if first is None:
            return chunk, 0, None
        tail = len(chunk) - 1
        while not self.space.match(chunk, tail):
            tail -= 1
        exit_, n = self.walk(_BETWEEN, chunk[tail + 1 :])
        return chunk[: first.start()], self.pieces(chunk[first.start() : tail + 1]) + n, exit_

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks in a row."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        place, n = self.walk(a[2], b[0])
        if b[2] is None:
            return a[0], a[1] + n, place
        return a[0], a[1] + n + self.finish(place) + b[1], b[2]

    def plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        self.machine.bound()
        maps = [self.chunk_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)] or [("", 0, None)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, inner, exit_ = maps[0]
        place, n = self.walk(_BETWEEN, head)
        return n + self.finish(place) + inner + (self.finish(exit_) if exit_ else 0)

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.added.split(text))) + len(self.added.findall(text))


_counter: dict[str, Counter] = {}


def _worker_counter(name: str, shared: Broadcast) -> Counter:
    """The compiled tokenizer that the driver sent, read once a worker."""
    if name not in _counter:
        _counter.clear()
        _counter[name] = pickle.loads(zlib.decompress(shared.value))
    return _counter[name]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every text."""
    small_batches(docs.sparkSession)
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(Counter(path)), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _worker_counter(name, shared)
        working("tokens", _counter.clear)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [machine.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
