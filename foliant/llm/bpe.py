"""BPE encoding and decoding through a deterministic automaton over tokens.

The automaton starts with one state and a loop for every byte.  Merges are
compiled in their order, each by one gadget: for (a, b) -> c,

* every state with an arc a whose target has an arc b gets an arc c to the
  target of b,
* the arcs a lead to a copy of their target without the arc b.

All arcs of one token lead to one state, so a state is kept as the state it was
copied from and the arc it lost, the target of c is the one of b at that time,
and c leaves the states that a left then.  Where no target of a has an arc b, the
merge never happens and c gets no arc.  Whether a token may follow another is
thus answered from two tables: the turn in which a token or a lost arc came up,
and each token's parts.  Paths spell exactly the segmentations that the merges
produce, one per string.

A pre-split word is encoded by following arcs, the longest first; each end
position has one valid path at most, so a position left behind is never entered
again.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrays import give_back, sliced

#: Words a worker remembers; twice as many at most.
REMEMBERED = 250_000
#: The published splitting pattern of this family of vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Automaton over token ids, compiled merge by merge."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocabulary.values()) + 1
        self.label: list[bytes] = [b""] * size
        for text, token in vocabulary.items():
            self.label[token] = text
        self.born = [-1] * size
        self.left = [-1] * size
        self.right = [-1] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.token = {bytes([b]): vocabulary[bytes([b])] for b in range(256) if bytes([b]) in vocabulary}
        for turn, (a, b) in enumerate(merges):
            self._gadget(turn, vocabulary[a], vocabulary[b], vocabulary[a + b])
        # labels as a trie of [children by byte, token]: the arcs' spellings
        self.trie: list = [{}, None]
        for text, t in self.token.items():
            node = self.trie
            for byte in text:
                node = node[0].setdefault(byte, [{}, None])
            node[1] = t
        self.allowed: dict[int, bool] = {}

    def _gadget(self, turn: int, a: int, b: int, c: int) -> None:
        if not self._arc(a, b):
            return  # no path spells a then b
        self.lost[a, b] = turn
        self.born[c], self.left[c], self.right[c] = turn, a, b
        self.token[self.label[c]] = c

    def arc(self, state: int, token: int) -> bool:
        """Has the state after ``state`` an arc ``token``?"""
        key = state << 20 | token
        known = self.allowed.get(key)
        if known is None:
            if len(self.allowed) > 4_000_000:
                self.allowed.clear()
            known = self.allowed[key] = self._arc(state, token)
        return known

    def _arc(self, state: int, token: int) -> bool:
        turn = 1 << 60  # arcs lost before this turn are gone
        while True:
            gone = self.lost.get((state, token))
            if gone is not None and gone < turn:
                return False
            s, t = self.born[state], self.born[token]
            if s < 0 and t < 0:
                return True
            if t > s:  # the arc came with its left part's arcs, after that turn's loss
                turn, token = min(turn, t + 1), self.left[token]
            elif s > t:  # the state was the target of its right part, before that turn's loss
                turn, state = min(turn, s), self.right[state]
            else:  # both came up in one turn
                turn, state, token = min(turn, s), self.right[state], self.left[token]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        allowed, label, n = self.allowed, self.label, len(word)
        path: list[int] = []
        open_arcs: list[list[int]] = []
        left_behind: set[int] = set()
        at = 0
        while at < n:
            arcs, node = [], self.trie
            for i in range(at, n):
                node = node[0].get(word[i])
                if node is None:
                    break
                if node[1] is not None:
                    arcs.append(node[1])
            while True:
                while arcs:
                    t = arcs.pop()
                    if path:
                        known = allowed.get(path[-1] << 20 | t)
                        if known is None:
                            known = self.arc(path[-1], t)
                        if not known:
                            continue
                    if left_behind and at + len(label[t]) in left_behind:
                        continue
                    break
                else:
                    left_behind.add(at)
                    if not path:
                        raise ValueError("a byte of the word has no token")
                    at -= len(label[path.pop()])
                    arcs = open_arcs.pop()
                    continue
                break
            path.append(t)
            open_arcs.append(arcs)
            at += len(label[t])
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


class JoinedSpace(Exception):
    """White space beside a blank or line end: the pattern must see both."""


class Remembered(dict):
    """Results of a function, kept for the most recent ``limit`` to ``2 * limit`` short arguments."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, text: str) -> bytes:
        made = self.older.get(text)
        if made is None:
            made = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[text] = made
        return made


class ByteBPE:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        letters = byte_letters()
        raw = lambda text: bytes(letters[c] for c in text)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {raw(text): token for text, token in model["vocab"].items() if text not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = TokenAutomaton(vocabulary, [(raw(a), raw(b)) for a, b in pairs])
        size = max([len(self.automaton.label) - 1, *special.values()]) + 1
        self.automaton.label += [b""] * (size - len(self.automaton.label))
        for text, token in special.items():
            self.automaton.label[token] = text.encode()
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        self.words = Remembered(self._word, remembered)
        self.units = Remembered(self._unit, remembered)

    def _word(self, text: str) -> bytes:
        return array("I", self.automaton.encode(text.encode())).tobytes()

    def _unit(self, unit: str) -> bytes:
        """Ids of a part that the pattern never joins with its neighbours."""
        body = unit[1:] if unit[0] in " \n" else unit
        if body[0].isspace() or body[-1].isspace():
            raise JoinedSpace
        return self.pieces(unit)

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.split_special and self.split_special.search(text):
            parts = self.split_special.split(text)
            return b"".join(
                np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts)
            )
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        Where blanks and line ends stand single between other letters, the
        pattern cuts before each blank and around each line end, so the parts
        between them are looked up whole.
        """
        if not text:
            return b""
        try:
            return b"".join(map(self.line, text.split("\n"), ["", *["\n"] * text.count("\n")]))
        except JoinedSpace:
            return self.pieces(text)

    def line(self, line: str, lead: str) -> bytes:
        first, *rest = line.split(" ")
        if not first or "" in rest:
            raise JoinedSpace
        return self.units[lead + first] + b"".join(map(self.units.__getitem__, [" " + p for p in rest]))

    def decode(self, ids: np.ndarray) -> str:
        return self.automaton.decode(ids.tolist()).decode("utf-8", "replace")


@contextmanager
def coder(path: str, remembered: int = REMEMBERED) -> Iterator[ByteBPE]:
    """A task's coder.  It goes with the task: compiling takes a third of a second, and idle workers hold no memory."""
    own = ByteBPE(path, remembered)
    try:
        yield own
    finally:
        del own
        give_back()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.  Null counts as empty."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        with coder(path) as own:
            yield from rows(batches, own)

    def rows(batches, own):
        for batch in sliced(batches, "text"):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                raw = own.encode(text or "")
                ids = np.frombuffer(raw, dtype="<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=names,
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(
    docs: DataFrame, path: str, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_tokens, token_ids, and whether they decode to the text.

    ``remembered`` words per task trade memory for time.
    """

    def run(batches):
        with coder(path, remembered) as own:
            yield from rows(batches, own)

    def rows(batches, own):
        for batch in sliced(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = [np.frombuffer(own.encode(t), dtype="<u4") for t in texts]
            ends = np.zeros(len(made) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in made], out=ends[1:])
            ids = np.concatenate(made).astype(np.int32) if made else np.zeros(0, np.int32)
            exact = [own.decode(x) == t for x, t in zip(made, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(exact)],
                names=["doc_id", "n_tokens", "token_ids", "exact"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, exact boolean")
