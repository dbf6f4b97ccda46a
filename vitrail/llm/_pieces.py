"""Texts as pieces that tokenize independently, and a bounded table of each piece's ids.

The split pattern of the rank files never lets one match cover a space that stands before a
non-space and after anything: such a space always begins a match.  So a text may be cut before
each of them, the pieces encoded one by one, and the ids put together, with the same result as for
the whole text.  Natural text repeats its pieces, so most are found in the table.

Everything but the encoding of new pieces is done in numpy over the UTF-8 bytes of many texts: cuts,
hashes of all pieces, look-ups, and the gathering of ids.  Pieces are found by 64-bit hash, and every
find is compared byte by byte, so no collision can change a result; pieces over MAX_PIECE bytes are
encoded each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from . import _common as C

#: At this many pieces the table is emptied (under 50 MB); longer pieces are never kept.
TABLE_PIECES, MAX_PIECE = 400_000, 200
#: Bytes of text handled at once.
CHUNK_BYTES = 500_000

#: First bytes of characters before which a space may not be cut: white space, and all of the
#: blocks E1 to E3, in which the other Unicode spaces lie (too few cuts do no harm).
_UNSAFE = np.zeros(256, bool)
_UNSAFE[[*range(9, 14), *range(28, 33), 0xE1, 0xE2, 0xE3]] = True

_EMPTY = np.uint64(0)


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of ``a`` and of ``b`` (arrays of bytes with eight spare ones) are equal, pair by pair."""
    out = np.ones(len(sizes), bool)
    wide = np.flatnonzero(sizes > C.LONG_WORD)
    for i in wide.tolist():
        out[i] = np.array_equal(a[at_a[i] : at_a[i] + sizes[i]], b[at_b[i] : at_b[i] + sizes[i]])
    x, y, k = _eight(a), _eight(b), 0
    todo = np.flatnonzero(sizes <= C.LONG_WORD) if len(wide) else np.arange(len(sizes))
    while len(todo):
        rest = sizes[todo] - k
        differ = (x[at_a[todo] + k] ^ y[at_b[todo] + k]) & C._BYTES[np.where(rest < 8, rest, 0)]
        out[todo[differ != 0]] = False
        todo, k = todo[(rest > 8) & (differ == 0)], k + 8
    return out


class PieceTable:
    """Ids of whole texts; ``encode`` gets the pieces (with their leading space) not yet known."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = TABLE_PIECES):
        self.encode, self.limit = encode, limit
        self.slots = 1 << (2 * limit - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(self.limit * 2, np.int64), np.zeros(self.limit * 2, np.int32)
        self.store = np.zeros(1 << 20, np.uint32)
        # The bytes of each piece, to compare with.
        self.bytes_at, self.bytes_n = np.zeros(self.limit * 2, np.int64), np.zeros(self.limit * 2, np.int32)
        self.bytes, self.bytes_used = np.zeros(1 << 20, np.uint8), 0

    def _cut(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of the pieces of texts that end at ``ends`` (empty texts have none)."""
        space = np.flatnonzero(raw == 32)
        inside = np.ones(len(raw) + 1, bool)
        inside[ends - 1] = False  # a text's last character begins nothing
        space = space[inside[space]]
        after = raw[space + 1]
        ok = ~_UNSAFE[after]
        c2 = np.flatnonzero(after == 0xC2)
        ok[c2] = ~np.isin(raw[np.minimum(space[c2] + 2, len(raw) - 1)], (0x85, 0xA0))
        begin = np.concatenate(([0], ends[:-1]))
        mark = np.zeros(len(raw), bool)
        mark[space[ok]] = True
        mark[begin[ends > begin]] = True
        return np.flatnonzero(mark)

    def _spans(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the pieces, ascending; ``raw`` has eight spare bytes."""
        starts = self._cut(raw[:-8], ends)
        return starts, np.append(starts[1:], len(raw) - 8)

    def _read(self, blob: bytes) -> np.ndarray:
        """The bytes to work on, and eight spare ones."""
        return np.frombuffer(blob + bytes(8), np.uint8)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        mask = self.slots - 1
        slot = (h >> np.uint64(20)).astype(np.int64) & mask
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            go = ~hit & (k != _EMPTY)
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        mask = self.slots - 1
        slot, todo = (h >> np.uint64(20)).astype(np.int64) & mask, np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = free & first
            self.keys[s[put]], self.entry[s[put]] = h[todo[put]], entries[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & mask

    def _add(self, ids: list[bytes]) -> np.ndarray:
        """Entries of newly encoded pieces."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(max(len(self.store), len(flat)), np.uint32)))
        if self.n + len(ids) > len(self.start):
            grow = np.zeros(max(len(self.start), len(ids)), np.int64)
            self.start, self.bytes_at = (np.concatenate((x, grow)) for x in (self.start, self.bytes_at))
            self.size, self.bytes_n = (np.concatenate((x, grow.astype(np.int32))) for x in (self.size, self.bytes_n))
        own = np.arange(self.n, self.n + len(ids))
        self.start[own] = self.used + np.cumsum(sizes) - sizes
        self.size[own] = sizes
        self.store[self.used : self.used + len(flat)] = flat
        self.n += len(ids)
        self.used += len(flat)
        return own

    def _remember(self, pieces: list[bytes], entries: np.ndarray) -> None:
        """Keep the bytes of pieces that go into the table."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        need = self.bytes_used + len(flat) + 8
        if need > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.zeros(max(len(self.bytes), need), np.uint8)))
        self.bytes_at[entries] = self.bytes_used + np.cumsum(sizes) - sizes
        self.bytes_n[entries] = sizes
        self.bytes[self.bytes_used : self.bytes_used + len(flat)] = flat
        self.bytes_used += len(flat)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text, as unsigned 32-bit arrays."""
        if self.n > self.limit:
            self.clear()
        blob = b"".join(texts)
        raw, ends = self._read(blob), np.cumsum([len(t) for t in texts])
        starts, stops = self._spans(raw, ends) if len(blob) else (ends[:0], ends[:0])
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        sizes = stops - starts
        h = C.hash_spans(raw, starts, sizes)
        # Pieces of one size up to eight bytes have different hashes (but for the one that stands for 0).
        sure = (sizes <= 8) & (h > np.uint64(1))
        h[h == 0] = 1
        entry = self._find(h)
        taken = entry >= 0  # by another piece, if not found
        found = taken & (self.bytes_n[entry] == sizes)
        at = np.flatnonzero(found & ~sure)
        found[at] = same_spans(raw, starts[at], self.bytes, self.bytes_at[entry[at]], sizes[at])
        new = np.flatnonzero(~found)
        if len(new):
            _, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            head = new[first[of]]
            alike = sizes[new] == sizes[head]
            alike[alike] = same_spans(raw, starts[new[alike]], raw, starts[head[alike]], sizes[new[alike]])
            # One of each hash, and every piece whose hash another piece has.
            at = np.concatenate((new[first], new[~alike]))
            view = raw.data
            pieces = [bytes(view[s:e]) for s, e in zip(starts[at].tolist(), stops[at].tolist())]
            own = self._add(self.encode([x.decode("utf-8", "replace") for x in pieces]))
            entry[new[alike]] = own[of[alike]]
            entry[new[~alike]] = own[len(first) :]
            keep = np.flatnonzero((sizes[at] <= MAX_PIECE) & ~taken[at] & (np.arange(len(at)) < len(first)))
            self._remember([pieces[i] for i in keep.tolist()], own[keep])
            self._insert(h[at[keep]], own[keep])
        size = self.size[entry].astype(np.int64)
        total = np.cumsum(size)
        flat = self.store[np.arange(total[-1]) + np.repeat(self.start[entry] - (total - size), size)]
        bounds = np.concatenate(([0], total))[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return [flat[s:e] for s, e in zip(bounds.tolist(), bounds[1:].tolist())]


def batches(texts, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the UTF-8 bytes of texts (null: empty), of about so many bytes together."""
    out, n = [], 0
    for t in C.as_bytes(texts):
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out
