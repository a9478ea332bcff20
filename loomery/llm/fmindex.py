"""A compressed full-text index over a shard of texts: wavelet matrix of the BWT, sampled suffix places, backward search."""

from __future__ import annotations

import numpy as np

LEVELS = 8
#: The symbol that closes a field; 0 ends the whole text.
CLOSE = 1
#: Every so many places of the text, and each field's first, are stored; the others are reached in as many steps at most.
RATE = 4
#: Stretches of so many symbols are noted in a bitmap; a pattern whose first stretch isn't there can't match.
GRAM = 8
KINDS = {"words": np.uint64, "ranks": np.uint32, "zeros": np.int64, "shift": np.int64, "two": np.int32, "marks": np.uint64, "mark_ranks": np.uint32, "places": np.int32, "starts": np.int64, "grams": np.uint64}


def symbols(cp: np.ndarray) -> np.ndarray:
    """Code points as symbols 2 to 255. Different letters may share one, so matches are a superset."""
    with np.errstate(over="ignore"):
        return (((cp.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)) % np.uint32(254) + 2).astype(np.uint8)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order: by eight symbols first, then rows still tied by doubled lengths."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        np.left_shift(key, np.uint64(8), out=key)
        np.bitwise_or(key, padded[j : j + n], out=key)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key, padded
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    rows = np.flatnonzero(tied)
    h = 8
    while len(rows):
        at = order[rows].astype(np.int64)
        # a suffix that ends within h symbols stands before those that go on, the shortest first
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)].astype(np.int64) + h + 1, n - at)
        both = rank[at].astype(np.int64) * (n + h + 1) + after
        by = np.argsort(both, kind="stable")
        both = both[by]
        order[rows] = at[by]
        new = np.ones(len(rows), bool)
        new[1:] = both[1:] != both[:-1]
        rank[order[rows]] = np.maximum.accumulate(np.where(new, rows, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = rows[tied]
        h *= 2
    return order


def _bits(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags in words of 64, and the number of set ones before each word."""
    packed = np.packbits(np.concatenate([flags, np.zeros(-len(flags) % 64 + 64, flags.dtype)]), bitorder="little").view(np.uint64)
    return packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]).astype(np.uint32)


def _gram_places(text: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = (h ^ text[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Index:
    """Search of a concatenation of fields, each with CLOSE before and after it."""

    def __init__(self, **own: np.ndarray):
        for k in KINDS:
            setattr(self, k, own[k])
        self.words, self.ranks = self.words.reshape(LEVELS, -1), self.ranks.reshape(LEVELS, -1)
        self.n = int(self.two[-1])
        self.gram_bits = 5 + len(self.grams).bit_length()

    @classmethod
    def build(cls, text: np.ndarray, starts: np.ndarray) -> Index:
        """text: symbols with CLOSE after each field; starts: where the fields begin."""
        text, starts = np.concatenate([[CLOSE], text, [0]]).astype(np.uint8), starts + 1
        n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        words, ranks, zeros = [], [], []
        level = bwt
        for b in range(LEVELS - 1, -1, -1):
            bit = (level >> np.uint8(b)) & np.uint8(1)
            packed, before = _bits(bit)
            words.append(packed)
            ranks.append(before)
            one = bit.astype(bool)
            zeros.append(int(n - one.sum()))
            level = np.concatenate([level[~one], level[one]])
        count = np.bincount(bwt, minlength=256)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        # where each symbol's run begins once all levels are sorted: by bits in reversed order
        begin = np.zeros(256, np.int64)
        some, at = np.unique(level, return_index=True)
        begin[some] = at
        # rows by their first two symbols, where every search begins
        pairs = np.bincount(text.astype(np.int64) * 256 + np.append(text[1:], 0), minlength=65536) if n else np.zeros(65536, np.int64)
        two = np.concatenate([[0], np.cumsum(pairs)]).astype(np.int32)
        kept = np.zeros(n, bool)
        kept[::RATE] = True
        kept[starts[starts < n]] = True
        marked = kept[order]
        marks, mark_ranks = _bits(marked.astype(np.uint8))
        bits = max(10, (8 * n).bit_length())
        flags = np.zeros(1 << bits, np.uint8)
        flags[_gram_places(text, np.arange(max(0, n - GRAM + 1)), bits)] = 1
        grams = np.packbits(flags, bitorder="little").view(np.uint64)
        return cls(
            words=np.array(words), ranks=np.array(ranks), zeros=np.array(zeros, np.int64), shift=(first - begin).astype(np.int64), two=two,
            marks=marks, mark_ranks=mark_ranks, places=order[marked], starts=starts.astype(np.int64), grams=grams,
        )

    def _ones(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set bits of a level before each place, and the bit at it."""
        w = at >> 6
        word, off = self.words[level][w], (at & 63).astype(np.uint64)
        return self.ranks[level][w].astype(np.int64) + np.bitwise_count(word & ((np.uint64(1) << off) - np.uint64(1))), (word >> off) & np.uint64(1)

    def extend(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each pattern with one symbol more in front."""
        both = np.concatenate([lo, hi])
        code = np.concatenate([sym, sym]).astype(np.int64)
        for level in range(LEVELS):
            ones, _ = self._ones(level, both)
            both = np.where((code >> (LEVELS - 1 - level)) & 1, self.zeros[level] + ones, both - ones)
        both += self.shift[code]
        return both[: len(lo)], both[len(lo) :]

    def may_stand(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each pattern's first symbols are in the bitmap; patterns shorter than GRAM always may."""
        ok = np.ones(len(begin), bool)
        long = np.flatnonzero(end - begin >= GRAM)
        place = _gram_places(text, begin[long], self.gram_bits)
        ok[long] = (self.grams[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
        return ok

    def search(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) that begin with text[begin:end], for each pattern; none for an empty pattern."""
        lo, hi = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        live = np.flatnonzero(end > begin)
        live = live[self.may_stand(text, begin[live], end[live])]
        at = end.astype(np.int64) - 2
        one = at < begin
        first = np.where(one, text[np.minimum(end - 1, max(0, len(text) - 1))] if len(text) else 0, 0).astype(np.int64)
        code = first * 256
        many = live[~one[live]]
        code[many] = text[at[many]].astype(np.int64) * 256 + text[at[many] + 1]
        lo[live], hi[live] = self.two[code[live]], self.two[np.where(one[live], code[live] + 256, code[live] + 1)]
        live = many[hi[many] > lo[many]]
        live = live[at[live] > begin[live]]
        while len(live):
            at[live] -= 1
            lo[live], hi[live] = self.extend(text[at[live]], lo[live], hi[live])
            live = live[(at[live] > begin[live]) & (hi[live] > lo[live])]
        return lo, np.maximum(hi, lo)

    def rare_pieces(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """Disjoint pieces of each text[begin:end], from its end on, each carried leftwards until at most ``most``
        rows match it: the number of the text, the piece's begin and end, and its rows [lo, hi)."""
        at, right = end.astype(np.int64).copy(), end.astype(np.int64).copy()
        lo, hi = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        fresh = np.ones(len(end), bool)
        found = [np.zeros((5, 0), np.int64)]
        live = np.flatnonzero(end - begin >= 2)
        while len(live):
            new, old = live[fresh[live]], live[~fresh[live]]
            right[new] = at[new]
            at[new] -= 2
            code = text[at[new]].astype(np.int64) * 256 + text[at[new] + 1]
            lo[new], hi[new] = self.two[code], self.two[code + 1]
            fresh[new] = False
            at[old] -= 1
            lo[old], hi[old] = self.extend(text[at[old]], lo[old], hi[old])
            done = live[hi[live] - lo[live] <= most]
            found.append(np.stack([done, at[done], right[done], lo[done], np.maximum(hi[done], lo[done])]))
            fresh[done] = True
            live = live[at[live] - begin[live] >= np.where(fresh[live], 2, 1)]
        return tuple(np.concatenate(found, 1))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the text each row's suffix begins: back to the nearest stored place."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = at[live]
            live = live[(self.marks[r >> 6] >> (r & 63).astype(np.uint64)) & np.uint64(1) == 0]
            r, code = at[live], np.zeros(len(live), np.int64)
            for level in range(LEVELS):
                ones, bit = self._ones(level, r)
                code = code << 1 | bit.astype(np.int64)
                r = np.where(bit == 1, self.zeros[level] + ones, r - ones)
            at[live] = r + self.shift[code]
            steps[live] += 1
        w = at >> 6
        before = np.bitwise_count(self.marks[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        return self.places[self.mark_ranks[w].astype(np.int64) + before] + steps

    def field(self, places: np.ndarray) -> np.ndarray:
        """The field that holds each place."""
        return np.searchsorted(self.starts, places, "right") - 1

    def pack(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(getattr(self, k)).astype(t, copy=False).tobytes() for k, t in KINDS.items()}

    @classmethod
    def unpack(cls, d: dict[str, bytes]) -> Index:
        return cls(**{k: np.frombuffer(d[k], t) for k, t in KINDS.items()})
