"""Byte-level BPE without a regex: class arrays, scans of transition functions, cached pair merging, offsets."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
import unicodedata
from itertools import chain

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: What the tokenizer's pattern takes as contractions, and as white space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CACHE_ENTRIES = 300_000
#: Characters that one function of the scan stands for, at each level.
BLOCK = 256


def ranks_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The vocabulary file: in ``folder``, $TOKENIZER_DIR or the installed package of vocabularies."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, one byte each."""
    of = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        k = kind.get(unicodedata.category(chr(cp))[0])
        if k is not None:
            of[cp] = k
    of[list(WHITE)] = SPACE
    return of


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other as code points, and where each begins (and the last ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


# What a character is to the scan: its class, and for some what follows it.
_LETTER, _NUMBER, _OTHER, _TAIL1, _TAIL2, _RUN, _LEAD, _ALONE = range(8)
# What the character before leaves behind: a closed piece, a run of letters, numbers, other characters or white space,
# a blank that leads in what follows, or a contraction that takes one or two characters more.
_CLOSED, _IN_LETTERS, _IN_NUMBERS, _IN_OTHER, _IN_SPACE, _LED, _TAKE1, _TAKE2 = range(8)


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The state after each (character, state before), and whether the character begins a piece; characters from 8 on
    are the first of their text, whose functions forget the state before."""
    after, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for c in range(8):
        for s in range(8):
            if s in (_TAKE1, _TAKE2):
                after[c, s], begins[c, s] = (_CLOSED if s == _TAKE1 else _TAKE1), False
            elif c in (_LETTER, _NUMBER, _OTHER):
                after[c, s] = own = {_LETTER: _IN_LETTERS, _NUMBER: _IN_NUMBERS, _OTHER: _IN_OTHER}[c]
                begins[c, s] = s not in (own, _LED)
            elif c in (_TAIL1, _TAIL2):  # an apostrophe with a contraction's tail behind it, unless it goes on with marks
                goes_on = s in (_IN_OTHER, _LED)
                after[c, s], begins[c, s] = (_IN_OTHER if goes_on else _TAKE1 if c == _TAIL1 else _TAKE2), not goes_on
            elif c == _RUN:
                after[c, s], begins[c, s] = _IN_SPACE, s != _IN_SPACE
            else:  # the last white space before other characters stands alone, or leads them in if it is a blank
                after[c, s] = _LED if c == _LEAD else _CLOSED
        after[c + 8], begins[c + 8] = after[c, _CLOSED], True
    return after, begins


def _scan(codes: np.ndarray, table: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
    """The state before each element, where ``codes`` number the rows of ``table`` (functions from state to state).

    Functions compose associatively: blocks are composed side by side, the blocks' own functions are scanned
    in the same way, and each block is then run from the state that stands before it.
    """
    n = len(codes)
    if n <= BLOCK:
        out, s = np.empty(n, np.uint8), int(start)
        for i, c in enumerate(codes.tolist()):
            out[i] = s
            s = int(table[c, s])
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.int64)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # one row for each place in a block
    states, flat = table.shape[1], table.ravel()
    whole = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    for step in grid:
        whole = flat[step[:, None] * states + whole]
    state = _scan(np.arange(rows), whole, start)
    out = np.empty((BLOCK, rows), np.uint8)
    for i, step in enumerate(grid):
        out[i] = state
        state = flat[step * states + state]
    return out.T.ravel()[:n]


def boundaries(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces begin that pairs are merged in.

    Each character is a function from the state before it to the state after it; the states before all characters
    come from one scan of these functions (_scan), and state and character decide whether a piece begins.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    code = np.array([_LETTER, _NUMBER, _RUN, _OTHER], np.uint8)[classes()[cp]]
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    space = code == _RUN
    lead = np.zeros(n, bool)
    lead[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    code[lead] = np.where(cp[lead] == 0x20, _LEAD, _ALONE)
    quote = np.flatnonzero(cp == 0x27)
    if len(quote):
        end = at[np.searchsorted(at, quote, "right")]
        for tail in CONTRACTIONS:
            ok = quote + len(tail) < end
            for j, c in enumerate(tail):
                ok &= cp[np.minimum(quote + 1 + j, n - 1)] == ord(c)
            code[quote[ok]] = _TAIL1 if len(tail) == 1 else _TAIL2
    code[first] += 8
    after, begins = _automaton()
    state = _scan(code, after)
    return np.flatnonzero(begins[code, state])


class ByteBPE:
    """Encodes texts; the merges of a piece are kept in a bounded cache."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # the pattern takes a piece whole, so that the library only merges pairs
        self.core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        vocab = sorted(self.ranks, key=self.ranks.get)
        #: The bytes of all tokens one after the other, and where each begins.
        self.bytes = np.frombuffer(b"".join(vocab), np.uint8)
        self.byte_at = np.concatenate([[0], np.cumsum([len(v) for v in vocab])])
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces of all texts, the first piece of each text, and the pieces' byte offsets."""
        cp, at = codepoints(texts)
        begin = boundaries(cp, at)
        width = np.ones(len(cp) + 1, np.int64)
        width[:-1] += (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        byte_at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width[:-1], out=byte_at[1:])
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        cut = np.append(byte_at[begin], byte_at[-1])
        ends = cut.tolist()
        found = [raw[a:b] for a, b in zip(ends, ends[1:])]
        return found, np.searchsorted(begin, at), cut

    def _merged(self, found: list[bytes]) -> list[tuple[int, ...]]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache, merge, ranks = self.cache, self.core.encode_ordinary, self.ranks
        out = []
        for b in found:
            ids = cache.get(b)
            if ids is None:
                one = ranks.get(b)
                ids = cache[b] = (one,) if one is not None else tuple(merge(b.decode("utf-8")))
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's ids begin (and the last end), and the byte of its text at which each id begins."""
        found, of_text, cut = self.pieces(texts)
        merged = self._merged(found)
        many = np.fromiter(map(len, merged), np.int64, len(merged))
        size = np.zeros(len(merged) + 1, np.int64)
        np.cumsum(many, out=size[1:])
        ids = np.fromiter(chain.from_iterable(merged), np.int32, int(size[-1]))
        # a piece's offset, and the lengths of the ids before in the piece
        wide = np.diff(self.byte_at)[ids]
        before = np.cumsum(wide) - wide
        inside = before - np.repeat(before[size[:-1]], many) if len(ids) else before
        at = size[of_text]
        offsets = np.repeat(cut[:-1], many) + inside - np.repeat(cut[of_text[:-1]], np.diff(at))
        return ids, at, offsets.astype(np.int32)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        found, of_text, _ = self.pieces(texts)
        size = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, self._merged(found)), np.int64, len(found)), out=size[1:])
        return np.diff(size[of_text])

    def decode(self, ids: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts whole again: each id's bytes are laid down at its offset."""
        ids, n = ids.astype(np.int64), np.diff(at)
        wide = np.diff(self.byte_at)[ids]
        if len(ids) and not (offsets[1:] == np.where(np.isin(np.arange(1, len(ids)), at), 0, offsets[:-1] + wide[:-1])).all():
            raise ValueError("offsets and ids don't belong together")
        total = np.zeros(len(n), np.int64)
        some = n > 0
        total[some] = offsets[at[1:][some] - 1] + wide[at[1:][some] - 1]
        begin = np.cumsum(total) - total
        place = np.repeat(np.repeat(begin, n) + offsets, wide) + np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        out = np.zeros(int(total.sum()), np.uint8)
        out[place] = self.bytes[np.repeat(self.byte_at[ids], wide) + np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)]
        raw = out.tobytes()
        return [raw[a : a + k].decode("utf-8") for a, k in zip(begin.tolist(), total.tolist())]


@functools.cache
def encoder(path: str) -> ByteBPE:
    """One encoder for each Python worker and file."""
    return ByteBPE(path)


def blocks(texts: list[str | None], most: int = 2_000_000):
    """Slices of at most ``most`` characters (or one text) in which texts are encoded together."""
    a = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)
