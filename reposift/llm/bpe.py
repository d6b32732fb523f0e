"""Byte-level BPE with contiguous rank arrays, on many words at once, and decoding."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern that splits text before merges, with white space spelled out as the Unicode property
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

NEVER = np.int32(np.iinfo(np.int32).max)
#: Words kept with their ids per worker, and the longest word kept; others are encoded anew when they come.
CACHED_WORDS, CACHED_LENGTH = 200_000, 48
LONG_WORD = 256
CHUNK_CHARACTERS = 1 << 20
#: Cells (words x bytes) merged together.
CELLS = 1 << 19


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte: itself, or one from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairRanks:
    """Ranks of merges by pair of ids: open addressing in one array, looked up for many pairs at once."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NEVER, np.int32)
        self.made = np.zeros(size, np.int32)
        left = np.arange(len(pairs))
        spot = self._spot(pairs)
        self.reach = 0
        while len(left):
            free = self.keys[spot] < 0
            taken, first = np.unique(spot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[taken] = pairs[left[placed]]
            self.rank[taken] = ranks[left[placed]]
            self.made[taken] = made[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, spot = left[rest], (spot[rest] + 1) % size
            self.reach += 1

    def _spot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; slots of unknown pairs hold the rank NEVER."""
        pairs = left.astype(np.int64) << 32 | right
        spot = self._spot(pairs)
        for _ in range(self.reach):
            other = np.flatnonzero((self.keys[spot] != pairs) & (self.keys[spot] >= 0))
            if not len(other):
                break
            spot[other] = (spot[other] + 1) % len(self.keys)
        return spot


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers JSON format, without normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids, merges = told["model"]["vocab"], told["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.by_pair = {(p >> 32, p & 0xFFFFFFFF): (r, m) for r, (p, m) in enumerate(zip(pairs.tolist(), made.tolist()))}
        self.pairs = PairRanks(pairs, np.arange(len(merges), dtype=np.int32), made)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = {i: bytes(of_letter[c] for c in text) for text, i in ids.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.bytes_list = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.words = regex.compile(SPLIT, regex.V1)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str | int, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers.

        A word is a row of part ids and a row of the ranks of adjacent parts.
        Each round finds every row's smallest rank, deletes the boundary after
        the part at its first place, moves the rest of the row up, and looks up
        the two ranks beside the new part.  Rows without a known pair are done.
        """
        out = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONG_WORD), key=lambda i: len(words[i]))
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self._merge_long(word)
        at = 0
        while at < len(order):
            width = len(words[order[at]])
            upto = at + 1
            while upto < len(order) and len(words[order[upto]]) <= width + 3 and (upto - at) * (width + 3) < CELLS:
                upto += 1
            self._merge_rows([words[i] for i in order[at:upto]], order[at:upto], out)
            at = upto
        return out

    def _merge_rows(self, words: list[bytes], order: list[int], out: list[bytes]) -> None:
        size = np.array([len(w) for w in words])
        width = int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        part = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1).astype(np.int32)
        rank = np.full((len(words), width), NEVER, np.int32)
        i, j = np.nonzero(np.arange(width - 1) < size[:, None] - 1)
        rank[i, j] = self.pairs.rank[self.pairs.find(part[i, j], part[i, j + 1])]
        where = np.array(order)
        while len(part):
            best = rank.argmin(axis=1)
            rows = np.arange(len(part))
            done = rank[rows, best] == NEVER
            if done.any():
                for row in np.flatnonzero(done):
                    out[where[row]] = part[row, : size[row]].astype("<u4").tobytes()
                left = ~done
                part, rank, size, where, best = part[left], rank[left], size[left], where[left], best[left]
                width = int(size.max(initial=0))
                part, rank, rows = part[:, :width], rank[:, :width], np.arange(len(part))
                if not len(part):
                    return
            slot = self.pairs.find(part[rows, best], part[rows, best + 1])
            moved = np.arange(width - 1)[None, :]
            later = moved > best[:, None]
            part[:, :-1] = np.where(later, part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            part[:, -1], rank[:, -1] = -1, NEVER
            part[rows, best] = self.pairs.made[slot]
            size = size - 1
            before = np.flatnonzero(best > 0)
            rank[before, best[before] - 1] = self.pairs.rank[self.pairs.find(part[before, best[before] - 1], part[before, best[before]])]
            rank[rows, best] = NEVER
            after = np.flatnonzero(best < size - 1)
            rank[after, best[after]] = self.pairs.rank[self.pairs.find(part[after, best[after]], part[after, best[after] + 1])]

    def _merge_long(self, word: bytes) -> bytes:
        """The same for a long word: the ranks wait in a heap, so that no round scans the whole word."""
        known, part = self.by_pair, self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*known[pair], i, *pair) for i, pair in enumerate(zip(part, part[1:])) if pair in known]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (part[x], part[y]) in known:
                    heapq.heappush(heap, (*known[part[x], part[y]], x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    def _parts(self, text: str) -> list[str | int]:
        """Words of a text, and the ids of the special tokens in it."""
        if not self.special or not any(s in text for s in self.special):
            return self.words.findall(text)
        parts: list[str | int] = []
        for place, piece in enumerate(self.cut.split(text)):
            parts += [self.special[piece]] if place % 2 else self.words.findall(piece)
        return parts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit integers; a null text counts as empty.

        Special tokens in a text become their ids, as the library does by default.
        """
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        cut = [self._parts(text or "") for text in texts]
        new = [w for w in set().union(*cut) if w not in cache]
        words = [w for w in new if isinstance(w, str)]
        cache.update(zip(words, self.merge([w.encode() for w in words])))
        cache.update((w, w.to_bytes(4, "little")) for w in new if isinstance(w, int))
        out = [b"".join([cache[w] for w in parts]) for parts in cut]
        for word in words:
            if len(word) > CACHED_LENGTH:
                del cache[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of little-endian 32-bit ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        known = self.bytes_list
        text = b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return text.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and file; the file must be at this path on every executor."""
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: ids of each whole text, packed as little-endian 32-bit integers, and the text decoded from them.

    A null text counts as empty: no ids, an empty decoded text.  Rows keep
    their doc_id, null or repeated.  Memory holds a batch of about
    CHUNK_CHARACTERS (or one longer text) and at most CACHED_WORDS words
    beyond it.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            column = batch.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // CHUNK_CHARACTERS
            first = np.r_[0, np.flatnonzero(np.diff(ends)) + 1]
            for a, b in zip(first, np.r_[first[1:], batch.num_rows]):
                if a == b:
                    continue
                ids = known.encode(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary()),
                     pa.array([known.decode(i) for i in ids], pa.binary()).cast(pa.string())],
                    ["doc_id", "ids", "decoded"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids binary, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
