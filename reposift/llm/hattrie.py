"""HAT-trie of word sequences: hash containers under a shallow trie of word ids, spilled as sorted runs."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A container of more entries bursts.
BURST = 16_384
#: Entries of the whole trie, and known words, beyond which subtrees are spilled.
MOST_ENTRIES, MOST_WORDS = 1_500_000, 400_000
#: The trie branches by the bytes of the first word's id, lowest first; so many levels at most.
LEVELS = 3
NONE = -1


class Words:
    """Ids of (language, word) pairs in order of appearance, with a 64-bit hash each."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.by_lang: dict[str, dict[bytes, int]] = {}
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.hashes = array("Q")

    def __len__(self) -> int:
        return len(self.words)

    def ids(self, lang: str, words: list[bytes], fit: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Ids of different words of one language; new ones whose hash isn't ``fit`` stay unknown and are NONE."""
        known = self.by_lang.setdefault(lang, {})
        found = np.array([known.get(w, NONE) for w in words], np.int32)
        new = np.flatnonzero(found == NONE)
        if len(new):
            seed = xxhash.xxh64_intdigest(lang)
            hashes = np.array([xxhash.xxh64_intdigest(words[i], seed) for i in new.tolist()], np.uint64)
            if fit is not None:
                good = fit(hashes)
                new, hashes = new[good], hashes[good]
            found[new] = np.arange(len(self), len(self) + len(new), dtype=np.int32)
            fresh = [words[i] for i in new.tolist()]
            known.update(zip(fresh, range(len(self), len(self) + len(new))))
            self.words += fresh
            self.langs += [lang] * len(new)
            self.hashes.frombytes(hashes.tobytes())
        return found


class _Node:
    """A container, or once burst a level of the trie (``children`` by byte).

    A container holds distinct packed sequences with counts and those that came
    since it was last put through the hash table.
    """

    __slots__ = ("keys", "counts", "waiting", "children", "entries")

    def __init__(self, keys: pa.Array, counts: np.ndarray) -> None:
        self.keys, self.counts, self.waiting = keys, counts, []
        self.children: dict[int, _Node] | None = None
        self.entries = len(counts)


class HatTrie:
    """Counts of word-id sequences of at most ``width`` ids.

    Sequences come as rows of a matrix, shorter ones filled up with NONE.  A
    row counts for itself and for all that it begins with: counts of prefixes
    are added up when a subtree is written.
    """

    def __init__(self, width: int):
        self.width = width
        self.kind = {1: pa.int32(), 2: pa.int64()}.get(width, pa.binary(4 * width))
        self.root = self._node()

    def _node(self) -> _Node:
        return _Node(pa.array([], self.kind), np.empty(0, np.int64))

    @property
    def entries(self) -> int:
        """Distinct sequences; those that wait count each."""
        return self.root.entries

    def _packed(self, rows: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(self.kind, len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])

    def _rows(self, packed: pa.Array) -> np.ndarray:
        rows = np.frombuffer(packed.buffers()[1], np.int32).reshape(-1, self.width)
        return rows[packed.offset : packed.offset + len(packed)]

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            self._add(self.root, rows, 0)

    def _add(self, node: _Node, rows: np.ndarray, level: int) -> int:
        before = node.entries
        if node.children is None:
            node.waiting.append(self._packed(rows))
            node.entries += len(rows)
            if node.entries - len(node.counts) > BURST:
                self._settle(node)
                if node.entries > BURST and level < LEVELS:
                    self._burst(node, level)
        else:
            for byte, some in self._dealt(rows, level):
                child = node.children.get(byte)
                if child is None:
                    child = node.children[byte] = self._node()
                node.entries += self._add(child, rows[some], level + 1)
        return node.entries - before

    def _settle(self, node: _Node) -> None:
        """Put what waits through the hash table."""
        if node.waiting:
            new = sum(map(len, node.waiting))
            table = pa.table({"key": pa.concat_arrays([node.keys, *node.waiting]), "n": np.r_[node.counts, np.ones(new, np.int64)]})
            table = table.group_by("key", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            node.keys, node.counts, node.waiting = table["key"].chunk(0), table["n_sum"].to_numpy(), []
            node.entries = len(node.counts)

    @staticmethod
    def _dealt(rows: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray]]:
        digits = (rows[:, 0] >> 8 * level & 255).astype(np.uint8)
        order = np.argsort(digits, kind="stable")
        first = np.r_[0, np.cumsum(np.bincount(digits, minlength=256))]
        for byte in np.flatnonzero(np.diff(first)).tolist():
            yield byte, order[first[byte] : first[byte + 1]]

    def _burst(self, node: _Node, level: int) -> None:
        """Deal a container's entries to one container per byte of the first word's id."""
        rows, node.children = self._rows(node.keys), {}
        for byte, some in self._dealt(rows, level):
            node.children[byte] = _Node(self._packed(rows[some]), node.counts[some])
        node.keys, node.counts = None, None

    def settle(self) -> int:
        """Put all that waits through the hash tables; the number of entries then."""
        self.root.entries = self._settled(self.root)
        return self.entries

    def _settled(self, node: _Node) -> int:
        if node.children is None:
            self._settle(node)
        else:
            node.entries = sum(map(self._settled, node.children.values()))
        return node.entries

    def _tables(self, node: _Node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if node.children is None:
            self._settle(node)
            yield self._rows(node.keys), node.counts
        else:
            for child in node.children.values():
                yield from self._tables(child)

    def take(self, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until ``share`` of all entries is out; their rows and counts."""
        root, taken, wanted = self.root, [], share * self.entries
        if root.children is None or share >= 1:
            taken, self.root = list(self._tables(root)), self._node()
        else:
            for byte in sorted(root.children, key=lambda b: -root.children[b].entries):
                if wanted <= 0:
                    break
                child = root.children.pop(byte)
                root.entries -= child.entries
                wanted -= child.entries
                taken += self._tables(child)
        return np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken])


def sorted_run(rows: np.ndarray, counts: np.ndarray, words: Words, shortest: int) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, f`` of all beginnings of ``shortest`` or more words, each length in the order of its words' bytes."""
    if not len(rows):
        return
    known = pa.table({"lang": pa.array(words.langs, pa.string()), "word": pa.array(words.words, pa.binary())})
    order = pc.sort_indices(known, [("lang", "ascending"), ("word", "ascending")])
    langs, spelt = known["lang"].take(order).combine_chunks(), known["word"].take(order).combine_chunks()
    rank = np.empty(len(words) + 1, np.int32)
    rank[order.to_numpy()] = np.arange(len(words), dtype=np.int32)
    rank[NONE] = NONE  # the last place, where NONE points
    rows = rank[rows]
    if rows.shape[1] == 2:
        at = np.argsort(rows[:, 0].astype(np.int64) << 32 | rows[:, 1])
    else:
        at = np.lexsort(rows.T[::-1])
    rows, counts = rows[at], counts[at]
    for length in range(shortest, rows.shape[1] + 1):
        some = rows[:, length - 1] != NONE
        own, f = rows[some, :length], counts[some]
        if not len(own):
            break
        first = np.r_[0, np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1]
        f, own = np.add.reduceat(f, first), own[first]
        for a in range(0, len(own), 1 << 17):
            part = own[a : a + (1 << 17)]
            columns = [spelt.take(pa.array(part[:, k])) for k in range(length)]
            phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if length > 1 else columns[0]
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(part[:, 0])), phrase.cast(pa.string()), pa.array(f[a : a + (1 << 17)])], ["lang", "phrase", "f"])
