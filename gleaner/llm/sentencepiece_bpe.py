"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

A word's candidate merges wait in an agenda, best score first, leftmost among equals. A keyed hash of the candidate
decides whether it is skipped when its turn comes; what stands next to a later merge is a new candidate. The key is
the seed, a hash of the text and the word's place in it, so every place draws anew, and the same seed gives the same
pieces on every run and machine. Only a word's agenda without skips is remembered, and serves the places that skip none of it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 7
CACHED = 500_000  # words whose pieces and agendas a worker remembers
SPACE = "▁"
_NEVER = (1 << 31) - 1
_MASK = (1 << 64) - 1
_WORD = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_SHORT = 64  # words of up to this many letters are worked out together
_WIDTHS = np.array([4, 6, 8, 10, 12, 14, 17, 21, 26, 34, 46, _SHORT])  # with others that fit the same width
_PAD = (1 << 31) - 1  # a symbol that merges with none
_PLACES = 1 << 17  # places that draw together


@dataclass
class Vocabulary:
    """Ranks of the pieces merges may make (0 is the best), ids, and the bytes each id stands for."""

    rank: dict[str, int]
    ids: dict[str, int]
    byte_ids: list[int]
    bytes_of: list[bytes]
    letters: dict[str, int]  # symbols: single letters first, then the pieces by rank
    symbol_ids: np.ndarray  # the id of each symbol, -1 where it is no piece
    pairs: np.ndarray  # two symbols that may merge, left << 32 | right, ascending
    merged: np.ndarray  # what they make
    merged_rank: np.ndarray


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece BPE model with byte fallback, whose pieces begin with a space or have none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if any(SPACE in pieces[i].lstrip(SPACE) for i in normal):
        raise ValueError("a piece holds a space after a letter; words cannot be encoded apart")
    order = sorted(normal, key=lambda i: (-model.get_score(i), i))
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    bytes_of = [pieces[i].replace(SPACE, " ").encode() for i in range(n)]
    for b, i in enumerate(byte_ids):
        bytes_of[i] = bytes([b])
    for i in set(range(n)) - set(normal) - set(byte_ids):
        bytes_of[i] = b""
    rank, ids = {pieces[i]: k for k, i in enumerate(order)}, {pieces[i]: i for i in normal}
    symbols = {c: k for k, c in enumerate(dict.fromkeys(c for p in rank for c in p))}
    letters = dict(symbols)
    for p in rank:
        symbols.setdefault(p, len(symbols))
    splits = sorted(
        (symbols[p[:k]] << 32 | symbols[p[k:]], symbols[p], r)
        for p, r in rank.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
    )
    pairs, merged, merged_rank = (np.array(c, np.int64) for c in zip(*splits, strict=True))
    symbol_ids = np.array([ids.get(p, -1) for p in symbols], np.int32)
    return Vocabulary(rank, ids, byte_ids, bytes_of, letters, symbol_ids, pairs, merged, merged_rank)


def _draw(key: int, rank: int, start: int) -> int:
    """A 32-bit number from the key and the candidate."""
    x = (key ^ (rank * 0x9E3779B97F4A7C15) ^ (start * 0xC2B2AE3D27D4EB4F)) & _MASK
    return (((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK) >> 32


def _mixed(rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What a candidate itself brings to its draw."""
    return (rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (start.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _numbers(key: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    x = key ^ mixed
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(32)
    return x


def _draws(key: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _numbers(key, _mixed(rank, start))


def _place_keys(key: int, first: int, n: int) -> np.ndarray:
    """Keys of a text's words from place `first` on (SplitMix64)."""
    x = (np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Agendas:
    """Words that were met: their pieces where no merge is skipped, and the candidates that are judged on that way."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.size = np.zeros(1 << 10, np.int64)  # letters of a word that is worked out together with others, else 0
        self.first, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.mixed, self.used = np.zeros(1 << 12, np.uint64), 0

    def add(self, words: list[str], fast: bool, ids: list[bytes], count: np.ndarray, ranks: np.ndarray, starts: np.ndarray) -> None:
        """`ranks` and `starts` are those of one word after the other, `count` of each."""
        n, end = len(self.ids), self.used + len(ranks)
        self.numbers.update(zip(words, range(n, n + len(words)), strict=True))
        self.ids += ids
        while len(self.ids) > len(self.first):
            self.first, self.count, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.size))
        while end > len(self.mixed):
            self.mixed = np.concatenate([self.mixed, np.zeros_like(self.mixed)])
        self.first[n:len(self.ids)] = self.used + np.cumsum(count) - count
        self.count[n:len(self.ids)] = count
        self.size[n:len(self.ids)] = np.fromiter(map(len, words), np.int64, len(words)) if fast else 0
        self.mixed[self.used:end] = _mixed(ranks, starts)
        self.used = end

    def skipping(self, numbers: np.ndarray, keys: np.ndarray, limit: int) -> np.ndarray:
        """Which of these places skip a candidate; taken in parts that stay in a core's cache."""
        found = np.zeros(len(numbers), bool)
        for cut in range(0, len(numbers), 1 << 13):
            own = numbers[cut:cut + (1 << 13)]
            count = self.count[own]
            ends = np.cumsum(count)
            c = np.arange(int(ends[-1])) + np.repeat(self.first[own] - ends + count, count)
            skip = np.flatnonzero(_numbers(np.repeat(keys[cut:cut + (1 << 13)], count), self.mixed[c]) < limit)
            found[cut + np.searchsorted(ends, skip, side="right")] = True
        return found


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.limit = int(dropout * (1 << 32))
        self.agendas = Agendas()
        # by code point: the symbol of a letter that is a piece by itself, else -1; the last entry stands for all others
        self.letters = np.full(max(map(ord, vocabulary.letters)) + 2, -1, np.int64)
        own = {ord(c): k for c, k in vocabulary.letters.items() if c in vocabulary.ids}
        self.letters[list(own)] = list(own.values())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of merging symbols side by side; _NEVER where they do not merge."""
        pair = (left << 32) | right
        at = np.searchsorted(self.v.pairs[:-1], pair)
        there = self.v.pairs[at] == pair
        return np.where(there, self.v.merged_rank[at], _NEVER), np.where(there, self.v.merged[at], -1)

    def _together(self, words: list[str], key: np.ndarray | None, tried: list | None = None) -> list[tuple[bytes, int]]:
        """Words whose letters are all known: a row of the matrix is the agenda of a word, filled up at its end.

        Without keys nothing is skipped; `tried` takes (rows, ranks, places) of the candidates of every step.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, length = len(words), int(size.max())
        alive = np.arange(length) < size[:, None]
        symbol = np.full((n, length), _PAD)
        symbol[alive] = self._symbols(words)
        after = np.tile(np.arange(1, length + 1), (n, 1))
        before = np.tile(np.arange(-1, length - 1), (n, 1))
        agenda, outcome = np.full((n, length), _NEVER, np.int32), np.full((n, length), -1)
        agenda[:, :-1], outcome[:, :-1] = self._ranks(symbol[:, :-1], symbol[:, 1:])
        skipped = np.zeros(n, np.int64)
        row = np.arange(n)
        while len(row):
            place = (agenda if len(row) == n else agenda[row]).argmin(axis=1)  # the leftmost of the best
            rank = agenda[row, place]
            some = rank < _NEVER
            row, place, rank = row[some], place[some], rank[some]
            if tried is not None:
                tried.append((row, rank, place))
            if self.limit and key is not None:
                skip = _draws(key[row], rank, place) < self.limit
                agenda[row[skip], place[skip]] = _NEVER
                skipped[row[skip]] += 1
                r, k = row[~skip], place[~skip]
            else:
                r, k = row, place
            gone = after[r, k]
            symbol[r, k] = outcome[r, k]
            alive[r, gone], agenda[r, gone] = False, _NEVER
            right = after[r, gone]
            after[r, k] = right
            agenda[r, k] = _NEVER
            in_word = right < length
            ri, ki, gi = r[in_word], k[in_word], right[in_word]
            before[ri, gi] = ki
            agenda[ri, ki], outcome[ri, ki] = self._ranks(symbol[ri, ki], symbol[ri, gi])
            left = before[r, k]
            inner = left >= 0
            ri, ki, li = r[inner], k[inner], left[inner]
            agenda[ri, li], outcome[ri, li] = self._ranks(symbol[ri, li], symbol[ri, ki])
        ids = self.v.symbol_ids[symbol[alive]].astype("<i4")
        whole, end = ids.tobytes(), np.cumsum(alive.sum(axis=1)) * 4
        start = np.concatenate([[0], end[:-1]]).tolist()
        return [(whole[a:b], s) for a, b, s in zip(start, end.tolist(), skipped.tolist(), strict=True)]

    def _by_heap(self, word: str, key: int | None) -> tuple[list[str], int, list[tuple[int, int]]]:
        """Pieces, number of skips and (rank, place) of every candidate; without a key nothing is skipped."""
        rank, skipped, tried = self.v.rank.get, 0, []
        n = len(word)
        part: list[str | None] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, str]] = []

        def put(k: int) -> None:
            both = part[k] + part[after[k]]
            if both in self.v.rank:
                heapq.heappush(agenda, (rank(both), k, both, len(part[k])))

        for k in range(n - 1):
            put(k)
        while agenda:
            best, k, both, left = heapq.heappop(agenda)
            right = after[k]
            if part[k] is None or len(part[k]) != left or right >= n or part[k] + part[right] != both:
                continue  # a merge has changed it since
            tried.append((best, k))
            if key is not None and _draw(key, best, k) < self.limit:
                skipped += 1
                continue
            part[k], part[right] = both, None
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                put(k)
            if before[k] >= 0:
                put(before[k])
        return [p for p in part if p is not None], skipped, tried

    def _bytes(self, pieces: list[str]) -> bytes:
        ids: list[int] = []
        for p in pieces:
            own = self.v.ids.get(p)
            ids += [own] if own is not None else [self.v.byte_ids[b] for b in p.encode()]
        return struct.pack(f"<{len(ids)}i", *ids)

    def _symbols(self, words: list[str]) -> np.ndarray:
        """Symbols of all letters of the words; -1 for a letter that is no piece."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.letters[np.minimum(codes, len(self.letters) - 1)]

    def _vectorised(self, words: list[str]) -> np.ndarray:
        """The number of letters of each word that can be worked out together with others, else 0."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        if not words:
            return size
        known = np.logical_and.reduceat(self._symbols(words) >= 0, np.cumsum(size) - size)
        return np.where(known & (size > 1) & (size <= _SHORT), size, 0)

    def _alike(self, places: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        """The places in parts that are worked out together, words of like length (`size`) in each."""
        width = np.searchsorted(_WIDTHS, size)
        order = np.argsort(width, kind="stable")
        width, places = width[order], places[order]
        for same in np.split(places, np.flatnonzero(np.diff(width)) + 1) if len(places) else ():
            yield from (same[cut:cut + (1 << 13)] for cut in range(0, len(same), 1 << 13))

    def _meet(self, words: list[str]) -> None:
        """Agendas of new words, those of like length worked out together."""
        size = self._vectorised(words)
        for k in np.flatnonzero(size == 0).tolist():
            pieces, _, tried = self._by_heap(words[k], None)
            rank, place = np.array(tried, np.int64).reshape(-1, 2).T
            self.agendas.add([words[k]], False, [self._bytes(pieces)], np.array([len(tried)]), rank, place)
        places = np.flatnonzero(size)
        for part in self._alike(places, size[places]):
            own, steps = [words[k] for k in part.tolist()], []
            made = self._together(own, None, steps)
            row, rank, place = (np.concatenate(x) for x in zip(*steps, strict=True))
            order = np.argsort(row, kind="stable")  # steps of a word stay in their order
            self.agendas.add(own, True, [ids for ids, _ in made], np.bincount(row, minlength=len(own)), rank[order], place[order])

    def _cut(self, words: list[str], keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids and skips of the words at places with these keys: every place judges its candidates by its own key."""
        if len(self.agendas.ids) > CACHED:
            self.agendas = Agendas()
        at = self.agendas
        self._meet([w for w in dict.fromkeys(words) if w not in at.numbers and len(w) <= _SHORT])
        number = np.fromiter(map(at.numbers.get, words, itertools.repeat(-1)), np.int64, len(words))
        known = number >= 0  # long words are worked out at every place
        short = np.flatnonzero(known)
        differs = ~known
        differs[short[at.skipping(number[short], keys[short], self.limit)]] = True
        ids, skipped = [at.ids[n] if n >= 0 else b"" for n in number.tolist()], np.zeros(len(words), np.int64)
        size = np.where(differs & known, at.size[number], 0)
        for k in np.flatnonzero(differs & (size == 0)).tolist():
            pieces, skipped[k], _ = self._by_heap(words[k], int(keys[k]))
            ids[k] = self._bytes(pieces)
        together = np.flatnonzero(size)
        for part in self._alike(together, size[together]):
            own = part.tolist()
            for k, (made, n) in zip(own, self._together([words[k] for k in own], keys[part]), strict=True):
                ids[k], skipped[k] = made, n
        return ids, skipped

    def _drawn(self, words: list[str], keys: np.ndarray) -> list[tuple[bytes, int]]:
        ids, skipped = self._cut(words, keys)
        return list(zip(ids, skipped.tolist(), strict=True))

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """For each whole text its ids as little-endian 32-bit numbers, and how many merges were skipped."""
        sign = struct.pack("<3i", *[self.v.byte_ids[b] for b in SPACE.encode()])
        ids: list[list[bytes]] = [[] for _ in texts]
        skipped = [0] * len(texts)
        words: list[str] = []
        keys: list[np.ndarray] = []
        runs: list[tuple[int, int, bool]] = []  # text, its next words, whether a sign stands before them

        def put() -> None:
            made, skips = self._cut(words, np.concatenate(keys)) if words else ([], np.zeros(0, np.int64))
            before, at = np.concatenate([[0], np.cumsum(skips)]).tolist(), 0
            for n, size, signed in runs:
                ids[n] += [sign] if signed else []
                ids[n] += made[at:at + size]
                skipped[n] += before[at + size] - before[at]
                at += size
            words.clear(), keys.clear(), runs.clear()

        for n, text in enumerate(texts):
            key, place = xxhash.xxh3_64_intdigest(text.encode(), self.seed), 0
            for k, part in enumerate(text.split(SPACE) if text else ()):  # a space sign in the text itself is told apart as bytes
                own, first = _WORD.findall((SPACE if not k else "") + part.replace(" ", SPACE)), place
                place += len(own)
                for cut in range(0, max(1, len(own)), _PLACES):
                    some = own[cut:cut + _PLACES]
                    words += some
                    keys.append(_place_keys(key, first + cut, len(some)))
                    runs.append((n, len(some), bool(k) and not cut))
                    if len(words) >= _PLACES:
                        put()
        put()
        return [(b"".join(i), s) for i, s in zip(ids, skipped, strict=True)]

    def encode(self, text: str) -> tuple[list[int], int]:
        """Ids of a whole text, and how many merges were skipped."""
        ids, skipped = self.encode_many([text])[0]
        return np.frombuffer(ids, "<i4").tolist(), skipped

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded: bytes of all pieces, less the space put before the text."""
        return b"".join(map(self.v.bytes_of.__getitem__, ids))[1:].decode() if len(ids) else ""


#: The last encoder of this Python worker: the next task with the same settings goes on with the words it has met.
_LAST: dict[tuple, Encoder] = {}


def _encoder(vocabulary: Vocabulary, *settings) -> Encoder:
    if settings not in _LAST:
        _LAST.clear()
        _LAST[settings] = Encoder(vocabulary, *settings[1:])
    return _LAST[settings]


def encode(
    docs: DataFrame, text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
) -> DataFrame:
    """`docs` with ids (array of int) and skipped (merges left out).

    The whole text is encoded. A null text has null ids, an empty one none. Equal texts get equal ids for one seed;
    another seed cuts them otherwise. Columns of these names are replaced.
    """
    return _coded(docs, text, model, dropout, seed, digest=False)


def encode_digest(
    docs: DataFrame, text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
) -> DataFrame:
    """`docs` with n_tokens, skipped, ids_sha256 (of the ids as little-endian 32-bit numbers) and lossless: whether the
    ids decode to the text. Ids are made and read back where the text is, and do not travel. Null counts as empty."""
    return _coded(docs, text, model, dropout, seed, digest=True)


def _coded(docs: DataFrame, text: str, model: str, dropout: float, seed: int, digest: bool) -> DataFrame:
    made = {"n_tokens": pa.int64(), "skipped": pa.int64(), "ids_sha256": pa.string(), "lossless": pa.bool_()} if digest else {
        "ids": pa.list_(pa.int32()), "skipped": pa.int64()}
    docs = docs.drop(*[c for c in made if c != text])
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # a vocabulary, whatever the corpus
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value, model, dropout, seed)
        for whole in batches:
            for cut in range(0, whole.num_rows, 200):
                batch = whole.slice(cut, 200)
                out: dict[str, list] = {c: [] for c in made}
                texts = batch.column(at).to_pylist()
                for t, (ids, skipped) in zip(texts, coder.encode_many([t or "" for t in texts]), strict=True):
                    numbers = np.frombuffer(ids, "<i4")
                    out["skipped"].append(skipped)
                    if digest:
                        out["n_tokens"].append(len(numbers))
                        out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                        out["lossless"].append(coder.decode(numbers.tolist()) == (t or ""))
                    else:
                        out["ids"].append(None if t is None else numbers)
                schema = batch.schema
                for c, kind in made.items():
                    schema = schema.append(pa.field(c, kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[c], kind) for c, kind in made.items()]], schema=schema)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    types = "n_tokens bigint, skipped bigint, ids_sha256 string, lossless boolean" if digest else "ids array<int>, skipped bigint"
    return docs.mapInArrow(work, f"{fields}, {types}")


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """`rows` with the text that `ids` stand for; null ids give null, none the empty text. `out` is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    rows = rows.drop(out) if out != ids else rows
    at = rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value, 0.0)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=batch.schema.append(pa.field(out, pa.string())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, `{out}` string")
