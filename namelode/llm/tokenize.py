"""Encoding of a corpus by a byte-level BPE vocabulary, as a lazily determinised transducer.

The encoding of every prefix of a word ends in one token, found from the tokens that end at the
position: it is the one that the token before it may stand beside, that is, whose pair the merges
leave apart. A state of the transducer therefore holds the places at which a longer token could
still begin, each with the tokens up to it; a byte moves to the next state, and whatever tokens all
these places share are certain and are emitted at once. No token is longer than the longest of the
vocabulary, so the lookahead is bounded by its length. States and moves are made when first needed.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how this vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its id on each line."""
    import base64

    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Transducer:
    """Encodes words (the pieces of the splitting pattern) by the merges of ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_words: int = 200_000):
        self.ranks = ranks
        # of every beginning of a token: its rank or -1, and whether a longer token begins so
        self.begun = {piece: (ranks.get(piece, -1), True) for piece in {token[:n] for token in ranks for n in range(1, len(token))}}
        self.begun |= {token: (rank, False) for token, rank in ranks.items() if token not in self.begun}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.max_states, self.max_words = max_states, max_words
        self.split = regex.compile(PATTERN).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside = lru_cache(1 << 18)(self._beside)
        self.words: dict[str, list[int]] = {}
        self._reset()

    def _reset(self) -> None:
        """Forgets the states made so far; they are made again when needed."""
        self.places: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.rest: list[tuple[int, ...]] = []
        self.number: dict[tuple, int] = {}
        self._state((None, ((b"", ()),)))

    def _state(self, key: tuple) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.places)
            self.places.append(key)
            self.moves.append({})
            self.rest.append(key[1][-1][1])
        return at

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a short piece by merging the lowest-ranked pair again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte, or if the merges don't make it."""
        known = self.halves.get(token, ())
        if known == ():
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(x + y, token), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def _beside(self, left: int | None, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as two tokens (``right`` as one at a start).

        They don't if, as both are put together from bytes, an earlier merge would join what stands at their border. From
        the last merges backwards, the side merged later is taken apart; whatever joins two halves must come after the
        merge that is taken back.
        """
        halves, bytes_of, get = self._halves, self.bytes_of, self.ranks.get
        if left is None:
            return len(bytes_of[right]) == 1 or halves(right) is not None
        limit = 1 << 30
        while True:
            joined = get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False
            if left > right and (two := halves(left)) or not halves(right):
                if not (two := halves(left)):
                    return True
                limit, left = left, two[1]
            else:
                limit, right = right + 1, halves(right)[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, places = self.places[state]
        step, now, kept, begun = bytes([byte]), None, [], self.begun
        for pending, tokens in places:
            piece = pending + step
            known = begun.get(piece)
            if known is not None:
                rank, longer = known
                if rank >= 0 and now is None and self.beside(tokens[-1] if tokens else last, rank):
                    now = (*tokens, rank)
                if longer:
                    kept.append((piece, tokens))
        kept.append((b"", now))
        if len(kept) == 1:
            return self._state((now[-1], ((b"", ()),))), now
        shared, first = 0, kept[0][1]
        if first and now[0] == first[0]:
            while all(len(t) > shared and t[shared] == first[shared] for _, t in kept):
                shared += 1
        sure = first[:shared]
        key = (sure[-1] if sure else last, tuple((p, t[shared:]) for p, t in kept))
        return self._state(key), sure

    def word(self, word: str) -> list[int]:
        """The ids of one word."""
        if len(self.places) > self.max_states:
            self._reset()
        out: list[int] = []
        state = 0
        for byte in word.encode("utf-8", "surrogatepass"):
            moves = self.moves[state]
            move = moves.get(byte)
            if move is None:
                move = moves[byte] = self._move(state, byte)
            state, sure = move
            if sure:
                out.extend(sure)
        out.extend(self.rest[state])
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for null and ''. Words seen lately are looked up."""
        ids: list[int] = []
        if not text:
            return ids
        words = self.words
        for word in self.split(text):
            known = words.get(word)
            if known is None:
                known = self.word(word)
                if len(word) <= 64:
                    if len(words) >= self.max_words:
                        words.clear()
                    words[word] = known
            ids += known
        return ids


#: Number of bytes that follow each first byte of a UTF-8 character, by ranges of first bytes.
FOLLOWING = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))
_FOLLOW = np.full(256, -1, np.int8)
for _low, _high, _n in FOLLOWING:
    _FOLLOW[_low : _high + 1] = _n


class StreamDecoder:
    """Turns ids into text as they arrive: holds back the bytes of a character that is not complete."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held, self.missing = bytes_of, bytearray(), 0

    def feed(self, ids: Iterable[int]) -> str:
        """The text that ``ids`` complete; bytes that can't belong to a character become U+FFFD."""
        ready: list[str] = []
        for token in ids:
            for byte in self.bytes_of[token]:
                if self.missing and 0x80 <= byte <= 0xBF:
                    self.held.append(byte)
                    self.missing -= 1
                else:
                    if self.held:
                        ready.append(self.held.decode("utf-8", "replace"))
                        self.held.clear()
                    self.missing = int(_FOLLOW[byte])
                    if self.missing < 0:
                        ready.append("�")
                        self.missing = 0
                        continue
                    self.held.append(byte)
                if not self.missing:
                    ready.append(self.held.decode("utf-8", "replace"))
                    self.held.clear()
        return "".join(ready)

    def end(self) -> str:
        """What is left of an unfinished character."""
        left = self.held.decode("utf-8", "replace")
        self.held.clear()
        self.missing = 0
        return left


_MADE: dict[int, Transducer] = {}


def _transducer(data: bytes) -> Transducer:
    """The worker's transducer of this vocabulary; workers are used again for later tasks."""
    key = hash(data)
    if key not in _MADE:
        _MADE[key] = Transducer(read_ranks(data))
    return _MADE[key]


def _id_lists(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_corpus(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every document by the vocabulary file at ``vocabulary``.

    Null and '' give an empty list; strings of special tokens are ordinary text; texts of any length
    are encoded whole. Rows keep their order and number, a null key stays null, other columns are not
    read. The vocabulary is broadcast: its size is fixed.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _transducer(shared.value).encode
        gc.disable()  # states and moves hold no cycles, but so many tuples that looking for some takes half of the time
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    lists = [encode(x) for x in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(lists)], [key, "ids"])
        finally:
            gc.enable()

    source = docs.select(key, text)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of each list of ids; null lists and empty ones give ''."""
    with open(vocabulary, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _transducer(shared.value).bytes_of
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = StreamDecoder(bytes_of)
                texts.append(decoder.feed(ids or ()) + decoder.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    source = encoded.select(key, "ids")
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, text string")
