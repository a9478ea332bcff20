"""Statistics of texts for problem 1, worked out for many texts at once on arrays of code points."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from .bpe import codepoints

#: Basic statistics, as they come out for each text.
BASIC = ("n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", "han_share", "punctuation_share")
#: What the mixture sees.
MORE = (
    "common", "sentences", "marked", "short_items", "enumerated", "cells", "named", "digits", "latin", "symbols", "marks", "foreign", "rare", "broken",
    "repeats", "restated", "interleaved", "long_tokens", "consonants", "log_line",
)

# Classes of characters. Which marks have a class of their own.
_CLASSES = ("common han", "han", "rare", "vowel", "consonant", "foreign", "letter", "digit", "stop", "dot", "comma", "pause", "semicolon", "colon", "equals", "pipe", "tab", "blank", "break", "mark", "symbol", "broken", "less", "more", "slash", "quote", "closer", "wide blank", "unseen")
(COMMON, HAN, RARE, VOWEL, CONSONANT, FOREIGN, LETTER, DIGIT, STOP, DOT, COMMA, PAUSE, SEMI, COLON, EQUALS, PIPE, TAB, BLANK, BREAK, MARK, SYMBOL, BROKEN, LESS, MORE_THAN, SLASH, QUOTE, CLOSER, WIDE, UNSEEN) = range(len(_CLASSES))
_OWN = {
    STOP: "。！？!?…｡", DOT: ".．", COMMA: "，,", PAUSE: "、", SEMI: "；;", COLON: "：:", EQUALS: "=", PIPE: "|│┃¦", TAB: "\t", BREAK: "\n\r\x0b\x0c\x85\u2028\u2029", LESS: "<", MORE_THAN: ">", SLASH: "/", QUOTE: "\"",
    CLOSER: "”’」』）)】》'", WIDE: "\u3000",
    UNSEEN: "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad\u180e",
}
PUNCTUATION, SYMBOLS = (STOP, DOT, COMMA, PAUSE, SEMI, COLON, SLASH, QUOTE, CLOSER, MARK), (EQUALS, PIPE, LESS, MORE_THAN, SYMBOL)
_BULLETS = "-*•·●○◦▪■□◆◇►▶–—+>☐☑☒✓✔✗"
_NUMERALS = "一二三四五六七八九十"
#: Tags of running text; those of cells and items are counted.
_TAG = re.compile(r"</?(?:p|div|br|span|b|i|em|strong|a|h\d|body|html|article|section|font|center|u|sup|sub|pre|code|blockquote)\b[^<>]*>", re.I)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point. Han letters that neither everyday list of GB 2312 or Big5 has are rare."""
    by = {"L": LETTER, "M": LETTER, "N": LETTER, "P": MARK, "S": SYMBOL, "C": BROKEN, "Z": BLANK}
    of = np.array([by[unicodedata.category(chr(c))[0]] for c in range(0x110000)], np.uint8)
    for c in range(0x3400, 0x30000):
        if 0x9FFF < c < 0xF900 or 0xFAFF < c < 0x20000:
            continue
        if unicodedata.category(chr(c)) == "Lo":
            of[c] = RARE
            for codec, low, high in (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6)):
                try:
                    if low <= chr(c).encode(codec)[0] <= high:
                        of[c] = HAN
                        break
                except UnicodeEncodeError:
                    pass
    for c in range(0x80, 0x250):
        if c not in (0x85, 0xA0, 0xA7, 0xB0, 0xB1, 0xB7, 0xD7, 0xF7):
            of[c] = FOREIGN
    for c in range(0x21, 0x80):
        ch = chr(c)
        of[c] = (VOWEL if ch.lower() in "aeiouy" else CONSONANT) if ch.isalpha() else DIGIT if ch.isdigit() else of[c]
    for k, chars in _OWN.items():
        of[list(map(ord, chars))] = k
    of[0xFFFD] = BROKEN
    return of


def _flags(chars: str) -> np.ndarray:
    of = np.zeros(0x110000, bool)
    of[list(map(ord, chars))] = True
    return of


_BULLET, _NUMERAL, _AFTER_NUMBER, _TOKEN = (_flags(x) for x in (_BULLETS, _NUMERALS, ".)、．）:：", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_%\\-"))
#: Letters of Latin words that are told apart: longer words aren't function words.
_WORD = 8


class Lexicon:
    """Function words: single Han letters as a class, Latin words by their letters."""

    def __init__(self, common: frozenset[str]):
        self.classes = classes().copy()
        for w in common:
            if len(w) == 1 and self.classes[ord(w)] == HAN:
                self.classes[ord(w)] = COMMON
        own = [w for w in common if w.isascii() and w.isalpha() and len(w) <= _WORD]
        self.latin = np.array(sorted(int.from_bytes(w.encode().ljust(_WORD, b"\0"), "little") for w in own), np.uint64)

    def is_latin(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words cp[start:end] are function words."""
        ok = np.zeros(len(start), bool)
        short = np.flatnonzero(end - start <= _WORD)
        if not len(short) or not len(self.latin):
            return ok
        key = np.zeros(len(short), np.uint64)
        for j in range(_WORD):
            at = start[short] + j
            c = cp[np.minimum(at, len(cp) - 1)].astype(np.uint64) | np.uint64(0x20)
            key |= np.where((at < end[short]) & (c < 0x80), c, 0).astype(np.uint64) << np.uint64(8 * j)
        place = np.minimum(np.searchsorted(self.latin, key), len(self.latin) - 1)
        ok[short] = self.latin[place] == key
        return ok


def _runs(flag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of set flags; a run ends with its text."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(len(flag), bool), np.zeros(len(flag), bool)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(flag))]
    before[edge], after[edge - 1] = False, False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def _clear_tags(texts: list[str], cp: np.ndarray, at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blank the tags of running text out; the number of cell tags and of item tags of each text."""
    cells, items = np.zeros(len(texts)), np.zeros(len(texts))
    less = np.flatnonzero(cls == LESS)
    for i in np.unique(np.searchsorted(at, less, "right") - 1).tolist():
        low = texts[i].lower()
        cells[i] = low.count("<td") + low.count("<th")
        items[i] = low.count("<li")
        few = low.count("\n") < 2
        for m in _TAG.finditer(texts[i]):
            cls[at[i] + m.start() : at[i] + m.end()] = BREAK if few else BLANK
    return cells, items


def _repeats(cp: np.ndarray, text: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each text's solid characters: the share of 4-grams seen before, counted in a map of the text's own size."""
    n = len(many)
    seen, grams = np.zeros(n), np.maximum(many - 3, 0)
    if len(cp) < 4:
        return seen
    c = cp.astype(np.uint64)
    h = ((c[:-3] * np.uint64(1000003) + c[1:-2]) * np.uint64(1000003) + c[2:-1]) * np.uint64(1000003) + c[3:]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    own = text[:-3]
    ok = own == text[3:]
    size = 8 * many
    first = np.cumsum(size) - size
    place = first[own] + ((h * size[own].astype(np.uint64)) >> np.uint64(31)).astype(np.int64)
    flag = np.zeros(int(size.sum()) + 1, np.uint8)
    flag[place[ok]] = 1
    some = np.flatnonzero(many >= 40)
    if len(some):
        edge = np.stack([first[some], first[some] + size[some]], 1).ravel()
        found = np.add.reduceat(flag, edge, dtype=np.int64)[::2]
        # places that different grams share: the expected number of distinct grams behind so many places
        distinct = -size[some] * np.log1p(-np.minimum(found, size[some] - 1) / size[some])
        seen[some] = np.clip(1 - distinct / grams[some], 0, 1)
    return seen


class _Lines:
    """Lines of a batch of texts: where they begin and end, and how often each class stands in each."""

    def __init__(self, cp: np.ndarray, cls: np.ndarray, at: np.ndarray, breaks: np.ndarray, lex: Lexicon):
        n = len(cp)
        start = np.zeros(n + 1, bool)
        start[1:] = breaks
        start[at] = True
        start = start[:n]
        line = np.cumsum(start, dtype=np.int32) - 1
        total = int(line[-1]) + 1 if n else 0
        k = len(_CLASSES)
        hist = np.bincount(line.astype(np.int64) * k + cls, minlength=total * k).reshape(total, k)
        solid = np.flatnonzero((cls != BLANK) & (cls != BREAK) & (cls != TAB) & (cls != WIDE) & ~breaks)
        own = line[solid]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        last = np.append(first[1:], len(own)) - 1 if len(first) else first
        kept = own[first]
        self.first, self.last, self.hist = solid[first], solid[last], hist[kept]
        self.text = np.searchsorted(at, self.first, "right") - 1
        self.size = self.last - self.first + 1
        place = np.full(total, -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.of = place
        self.line = line
        # words: Han letters one by one, runs of other letters and of digits
        letters = (cls >= VOWEL) & (cls <= LETTER)
        a, b = _runs(letters, at)
        digits, _ = _runs(cls == DIGIT, at)
        h = self.hist
        self.words = h[:, COMMON] + h[:, HAN] + h[:, RARE] + self.count(a) + self.count(digits)
        self.common = h[:, COMMON] + self.count(a[lex.is_latin(cp, a, b)])
        self.word_chars = h[:, : DIGIT + 1].sum(1)

    def count(self, places: np.ndarray) -> np.ndarray:
        """How many of the places lie in each line."""
        own = self.of[self.line[places]]
        return np.bincount(own[own >= 0], minlength=len(self.first))

    def first_of(self, places: np.ndarray) -> np.ndarray:
        """The first of the places in each line, or a place behind the line's end."""
        out = self.last + 1_000_000
        own = self.of[self.line[places]]
        ok = own >= 0
        own, places = own[ok], places[ok]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[new]] = places[new]
        return out

    def named(self, cls: np.ndarray) -> np.ndarray:
        """Which lines are a short name, a colon or equals sign, and a value."""
        colon = self.first_of(np.flatnonzero((cls == COLON) | (cls == EQUALS)))
        comma = self.first_of(np.flatnonzero((cls == COMMA) | (cls == STOP)))
        name, value = colon - self.first, self.last - colon
        return (name >= 1) & (name <= 24) & (value >= 1) & (value <= 60) & (comma > colon) & (self.hist[:, STOP] == 0) & (self.common <= 0.25 * self.words)


def _markers(cp: np.ndarray, cls: np.ndarray, ln: _Lines) -> np.ndarray:
    """Which lines begin as an item does: a bullet, a number or letter with its mark, a box, a step."""
    n = len(cp)

    def at(k):
        i = ln.first + k
        return np.where(i <= ln.last, cp[np.minimum(i, n - 1)], 0), np.where(i <= ln.last, cls[np.minimum(i, n - 1)], BREAK)

    (c0, k0), (c1, k1), (c2, k2), (c3, k3) = (at(k) for k in range(4))
    low = [c | 0x20 for c in (c0, c1, c2, c3)]
    number = (k0 == DIGIT) & (_AFTER_NUMBER[c1] & (k2 != DIGIT) | (k1 == DIGIT) & (_AFTER_NUMBER[c2] & (k3 != DIGIT) | (k2 == DIGIT) & _AFTER_NUMBER[c3]))
    opened = (c0 == ord("（")) | (c0 == ord("("))
    return (
        _BULLET[c0] | number | opened & ((k1 == DIGIT) | _NUMERAL[c1]) | _NUMERAL[c0] & (_AFTER_NUMBER[c1] | _NUMERAL[c1] & _AFTER_NUMBER[c2])
        | (c0 >= 0x2460) & (c0 <= 0x2473) | (c0 >= 0x2776) & (c0 <= 0x277F)
        | (c0 == ord("步")) & ((c1 == ord("骤")) | (c1 == ord("驟"))) | (c0 == ord("第")) & ((k1 == DIGIT) | _NUMERAL[c1])
        | (low[0] == ord("s")) & (low[1] == ord("t")) & (low[2] == ord("e")) & (low[3] == ord("p")) | (low[0] == ord("i")) & (low[1] == ord("t")) & (low[2] == ord("e")) & (low[3] == ord("m"))
        | (c0 == ord("[")) & ((c1 == ord("]")) | (c2 == ord("]"))) | (c0 == ord("【")) & (cp[np.minimum(ln.last, n - 1)] == ord("】")) & (ln.size <= 26)
        | ((k0 == VOWEL) | (k0 == CONSONANT)) & ((c1 == ord(".")) | (c1 == ord(")"))) & (k2 == BLANK)
    )


def batch_stats(texts: list[str], lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of BASIC and of MORE for each text."""
    n = len(texts)
    cp, at = codepoints(texts)
    cls = lex.classes[cp]
    unseen = cls == UNSEEN
    if unseen.any():
        kept = np.concatenate([[0], np.cumsum(~unseen)])
        texts = [_UNSEEN.sub("", t) for t in texts]
        cp, cls, at = cp[~unseen], cls[~unseen], kept[at]
    basic, more = np.zeros((n, len(BASIC))), np.zeros((n, len(MORE)))
    if not len(cp):
        return basic, more
    raw = cls.copy()
    cell_tags, item_tags = _clear_tags(texts, cp, at, cls)
    ln = _Lines(cp, cls, at, cls == BREAK, lex)
    if not len(ln.first):
        return basic, more

    def total(values, lines=ln):
        return np.bincount(lines.text, weights=values, minlength=n)

    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    k = len(_CLASSES)
    count = np.bincount(text.astype(np.int64) * k + raw, minlength=n * k).reshape(n, k).astype(float)
    solid = np.maximum(1, count.sum(1) - count[:, (BLANK, BREAK, TAB, WIDE)].sum(1))
    han, punct, sym = count[:, :VOWEL].sum(1), count[:, PUNCTUATION].sum(1), count[:, SYMBOLS].sum(1)
    latin = count[:, VOWEL] + count[:, CONSONANT]
    lines = total(np.ones(len(ln.first)))

    # whether a line ends as a sentence does, closing marks aside
    end = ln.last.copy()
    for _ in range(4):
        back = ((cls[end] == CLOSER) | (cls[end] == QUOTE)) & (end > ln.first)
        end -= back
    ends = (cls[end] == STOP) | (cls[end] == DOT) | (cls[end] == SEMI)
    words, common = total(ln.words), total(ln.common)
    shared = common / np.maximum(1, words)
    basic[:] = np.stack([words, total(ln.word_chars) / np.maximum(1, words), (punct + sym) / solid, total(ends) / np.maximum(1, lines), shared, han / solid, punct / solid], 1)

    # --- lines: what is said, marked, short, enumerated, named ---
    size = total(ln.size)
    h, w, fn = ln.hist, ln.words, ln.common
    chinese = h[:, :VOWEL].sum(1) > 0
    clause = np.isin(cls[ln.last], (STOP, DOT, COMMA, PAUSE, SEMI, COLON))
    clauses = h[:, STOP : COLON + 1].sum(1) - clause
    marker = _markers(cp, cls, ln)
    parts = 1 + h[:, (COMMA, PAUSE, SEMI, SLASH)].sum(1)
    enum = (clauses >= 2) & (parts >= 3) & (fn <= 0.08 * w) & (ln.size / parts <= np.where(chinese, 15, 26))
    said = ~enum & ((w >= 5) & ((fn >= 0.1 * w) | (fn > 0) & (clauses > 0) | (w >= 12) & (fn + clauses >= 2)) | (fn >= 0.2 * np.maximum(1, w)) & (w >= 3))
    marked = ~enum & ~said & marker
    short = ~enum & ~said & ~marker & (ln.size <= np.where(chinese, 24, 48))
    named = total(np.where(ln.named(cls), ln.size, 0)) / np.maximum(1, size)
    many_fields = np.flatnonzero(count[:, SEMI] >= 2)
    if len(many_fields):  # fields one after the other in a line
        seg = _Lines(cp, cls, at, (cls == BREAK) | (cls == SEMI), lex)
        good = seg.named(cls) & (seg.size <= 70)
        share = total(good, seg) / np.maximum(1, total(np.ones(len(seg.first)), seg))
        inside = total(np.where(good, seg.size, 0), seg) / np.maximum(1, total(seg.size, seg))
        ok = (share >= 0.8) & (count[:, SEMI] >= 2)
        named = np.where(ok, np.maximum(named, inside), named)
    pair = np.flatnonzero((cls[:-1] == QUOTE) & (cls[1:] == COLON))
    if len(pair):
        for i in np.unique(text[pair]).tolist():
            edge = texts[i].strip()
            if edge[:1] in "{[" and edge[-1:] in "}]":
                try:
                    got = json.loads(edge)
                    named[i] = 1.0 if isinstance(got, dict) or got and isinstance(got, list) and isinstance(got[0], (dict, list)) else named[i]
                except (ValueError, RecursionError):
                    named[i] = 1.0 if edge.count('":') >= 2 else named[i]

    # --- cells: lines with the same number of separators ---
    gap = np.flatnonzero((cls[1:-1] == BLANK) & (cls[2:] != BLANK) & (cls[:-2] == BLANK) & (text[2:] == text[:-2])) + 1
    grid = np.flatnonzero(h[:, : DIGIT + 1].sum(1) > 0)  # not rules
    of = ln.text[grid]
    rows = np.bincount(of, minlength=n)
    cells = np.where(cell_tags >= 4, 1.0, 0.0)
    for sep in (h[:, TAB], h[:, PIPE], h[:, COMMA], h[:, SEMI], ln.count(gap) + h[:, WIDE]):
        c = sep[grid]
        if not c.any():
            continue
        key, same = np.unique(of * 1024 + np.minimum(c, 1023), return_counts=True)
        owner, value = key >> 10, key & 1023
        order = np.lexsort((value, same, owner))
        best = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
        top, often = np.zeros(n), np.zeros(n)
        top[owner[best]], often[owner[best]] = value[best], same[best]
        fine = (rows >= 2) & (solid / np.maximum(1, np.bincount(of, weights=c + 1, minlength=n)) <= 14)
        least = np.full(n, 1 << 20)
        np.minimum.at(least, of, c)
        full = np.where((top >= 1) & (often >= 2), often / np.maximum(1, rows), np.where((shared < 0.05) & (least >= 1), 0.9, 0.0))
        cells = np.where(fine, np.maximum(cells, full), cells)

    # --- wrapped text has lines of one length ---
    order = np.lexsort((ln.size, ln.text))
    first = np.searchsorted(ln.text[order], np.arange(n))
    some = lines > 0
    low, high = np.zeros(n), np.zeros(n)
    low[some] = ln.size[order][(first + lines // 5).astype(np.int64)[some]]
    high[some] = ln.size[order][(first + lines - 1).astype(np.int64)[some]]
    wrapped = (lines >= 3) & (high - low <= 8) & (high >= 16)

    # --- junk ---
    plain = (raw != BLANK) & (raw != BREAK) & (raw != TAB) & (raw != WIDE)
    repeats = _repeats(cp[plain], text[plain], np.bincount(text[plain], minlength=n))
    restated = np.zeros(n)
    spaces = count[:, BLANK]
    for i in np.flatnonzero((han > 0) & (spaces >= 9) & (spaces > solid / 10)).tolist():
        own = [x for x in texts[i].split() if x[0] >= "一"]
        if len(own) >= 10 and 2 * len(own) < solid[i] < 9 * len(own):
            restated[i] = 1 - len(set(own)) / len(own)
    mark = np.zeros(k, bool)
    mark[list(PUNCTUATION + SYMBOLS)] = True
    mark = mark[raw]
    alone = np.zeros(n)
    if len(cp) > 2:
        alone = np.bincount(text[1:-1][mark[:-2] & ~mark[1:-1] & plain[1:-1] & mark[2:] & (text[:-2] == text[2:])], minlength=n)
    a, b = _runs(_TOKEN[cp], at)
    long = b - a >= 24
    tokens = np.bincount(text[a[long]], weights=(b - a)[long], minlength=n)
    a, b = _runs(raw == CONSONANT, at)
    long = b - a >= 4
    consonants = np.bincount(text[a[long]], weights=(b - a)[long], minlength=n)
    size = np.maximum(1, size)
    said_share = total(np.where(said, ln.size, 0)) / size
    more[:] = np.stack([
        shared, said_share, np.where(item_tags > 0, np.maximum(total(np.where(marked, ln.size, 0)) / size, 1 - said_share), total(np.where(marked, ln.size, 0)) / size),
        np.where(wrapped & (shared >= 0.05), 0, total(np.where(short, ln.size, 0)) / size), total(np.where(enum, ln.size, 0)) / size, cells, named,
        count[:, DIGIT] / solid, latin / solid, sym / solid, punct / solid, count[:, FOREIGN] / solid, np.where(han >= 10, count[:, RARE] / np.maximum(1, han), 0), count[:, BROKEN] / solid,
        repeats, restated, alone / solid, tokens / solid, consonants / np.maximum(20, latin), np.where(lines > 0, np.log1p(size / np.maximum(1, lines)), 0),
    ], 1)
    return basic, more


_UNSEEN = re.compile("[" + "".join(_OWN[UNSEEN]) + "]")
