"""Problem 2: records of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from .bpe import codepoints
from .common import plain_key
from .fmindex import CLOSE, KINDS, Index, symbols

#: Symbols of one index shard: MOST fits a task's memory many times over; smaller inputs give each core a shard, down to LEAST.
MOST_SYMBOLS, LEAST_SYMBOLS = 8_000_000, 400_000
#: Training symbols of one task.
TASK_SYMBOLS = 20_000_000
#: One character in so many of the longer text may differ.
ONE_IN = 10
#: Training texts searched together, and hits looked at together.
SEARCH_ROWS, HITS = 8000, 500_000
#: Hits of pieces of even length that are looked at as they are, for each piece.
FEW = 4
#: Otherwise the rows that a piece may match, tried one after the other until a text falls into enough pieces.
RARE = (8, 128)
#: Texts are taken apart side by side in stretches of so many letters.
STRETCH = 256
#: Tasks that the members of one class are spread over.
SALTS = 16
_BINS = 64
#: Length classes of sources (coarse, they name folders) and of targets. Near texts lie at most one and three classes apart.
_SOURCE_STEPS, _TARGET_STEPS = 5, 20


def _norm(c: str) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def _length_class(c: str, steps: int) -> Column:
    return F.floor(F.log1p(F.length(c)) * steps).cast("int")


def near(a: str, b: str) -> bool:
    """At most one character in ONE_IN of the longer text is inserted, removed or replaced."""
    k = max(len(a), len(b)) // ONE_IN
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    return distance(a[: len(a) - tail], b[: len(b) - tail], k) <= k


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, a column of differences at a time in the bits of one number; any number over ``most`` if it is over that."""
    if not a or not b:
        return len(a) or len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    m = len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    over = float("inf") if most is None else most + len(b)  # the distance falls by one with each letter left at most
    for j, c in enumerate(b, 1):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score + j > over:
            return score + j - len(b)
        ph = (ph << 1) | 1
        pv = ((mh << 1) | (full & ~(xv | ph))) & full
        mv = ph & xv & full
    return score


def _histograms(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each text has the letters of each of _BINS bins."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(text * _BINS + cp % _BINS, minlength=n * _BINS).reshape(n, _BINS).clip(0, 32_000).astype(np.int16)


def _build(g: pd.DataFrame) -> pd.DataFrame:
    """The index of one shard: of each class the field s and the field t."""
    parts = [x for s, t in zip(g["s"], g["t"]) for x in (s, t)]
    cp, at = codepoints(parts)
    n = len(parts)
    text = np.full(len(cp) + n, CLOSE, np.uint8)
    text[np.arange(len(cp)) + np.repeat(np.arange(n), np.diff(at))] = symbols(cp)
    ix = Index.build(text, at[:-1] + np.arange(n))
    row = {"shard": int(g["shard"].iloc[0]), **ix.pack(), "keys": b"".join(g["key"]), "texts": "".join(parts).encode(), "lengths": np.diff(at).astype(np.int32).tobytes()}
    return pd.DataFrame([row])


_INDEX = "shard int, " + ", ".join(f"{k} binary" for k in KINDS) + ", keys binary, texts binary, lengths binary"


class Shard:
    def __init__(self, row: dict):
        self.index = Index.unpack(row)
        self.keys = [row["keys"][i : i + 16] for i in range(0, len(row["keys"]), 16)]
        self.length = np.frombuffer(row["lengths"], np.int32).reshape(-1, 2).astype(np.int64)
        self.text = row["texts"].decode()
        self.at = np.concatenate([[0], np.cumsum(self.length.ravel())])
        self.least, self.most = (self.length.min(0), self.length.max(0)) if len(self.length) else (np.zeros(2), np.zeros(2))

    def field(self, i: int, f: int) -> str:
        return self.text[self.at[2 * i + f] : self.at[2 * i + f + 1]]

    def may_match(self, length: np.ndarray) -> np.ndarray:
        """Which texts have, in both fields, a length near one of the shard's."""
        return ((length * ONE_IN >= self.least * (ONE_IN - 1)) & (length * (ONE_IN - 1) <= self.most * ONE_IN)).all(1)


def load_shard(path: str, shard: int) -> Shard | None:
    """A shard of the index from the folder all executors share; None if no class fell into it."""
    for file in _dataset([f"{path}/shard={shard}"]):
        found = Shard(file.to_table().to_pylist()[0])
        pa.default_memory_pool().release_unused()
        return found
    return None


def _dataset(folders: list[str]):
    """The Parquet files in folders of the shared file system, each as a dataset of its own."""
    import pyarrow.dataset as ds
    import pyarrow.fs

    found = []
    for folder in folders:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        files = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        found += [ds.dataset(f.path, format="parquet", filesystem=fs) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet")]
    return found


def _pieces(lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of disjoint pieces, one more than edits are allowed: one must stand unchanged."""
    many = np.where(lengths > 0, lengths // (ONE_IN - 1) + 1, 0)
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    n, p = lengths[text], many[text]
    return at[text] + n * k // np.maximum(p, 1), at[text] + n * (k + 1) // np.maximum(p, 1), text


def matched_spans(a: np.ndarray, b: np.ndarray, off: list[int], width: int) -> tuple[int, int]:
    """(spans, covered): the maximal matches of at least ``width`` letters on the diagonals given, merged in ``a``."""
    hit = np.zeros(len(a), bool)
    for d in set(off):  # a[i] stands against b[i + d]
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        if hi - lo < width:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (a[lo:hi] == b[lo + d : hi + d]).astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if y - x >= width:
                hit[lo + x : lo + y] = True
    return int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum()), int(hit.sum())


def _rare(ix: Index, sym: np.ndarray, at: np.ndarray, which: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hits (text, offset, lo, hi) of one rare piece more than edits are allowed; and which texts have so many."""
    n = np.diff(at)
    parts = np.where(which, -(-n // STRETCH), 0)
    text = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = at[text] + k * STRETCH
    part, left, _, lo, hi = ix.rare_pieces(sym, begin, np.minimum(begin + STRETCH, at[text + 1]), most)
    owner = text[part]
    order = np.lexsort((hi - lo, owner))
    owner, left, lo, hi = owner[order], left[order], lo[order], hi[order]
    need = n // (ONE_IN - 1) + 1
    enough = which & (np.bincount(owner, minlength=len(n)) >= need)
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    use = enough[owner] & (nth < need[owner]) & (hi > lo)
    return np.stack([owner, left - at[owner], lo, hi])[:, use], enough


def search_shard(sh: Shard, keys: list[bytes], s: list[str], t: list[str]) -> list[tuple[bytes, bytes, int, int]]:
    """(training key, evaluation key, spans, covered) of classes that are nearly the same in both fields.

    Either field is complete by itself: the shorter one that isn't empty is searched. Fields too short for an edit
    must be equal. Others are cut into pieces of even length, one more than edits are allowed. Where those have many
    hits, the text is cut into pieces that few rows match; where it has too few of those, pieces of even length are
    searched in both fields, and the field with fewer hits is taken.
    """
    n, ix = len(keys), sh.index
    fields = [codepoints(s), codepoints(t)]
    syms = [symbols(cp) for cp, _ in fields]
    length = np.stack([np.diff(at) for _, at in fields], 1)
    first = np.where((length[:, 1] > 0) & ((length[:, 1] <= length[:, 0]) | (length[:, 0] == 0)), 1, 0)
    found: list[list[np.ndarray]] = [[], []]
    for f in (0, 1):
        at = fields[f][1]
        short = np.flatnonzero((first == f) & (length[:, f] > 0) & (length[:, f] < ONE_IN - 1))
        if len(short):  # the closing symbols of the field before and of its own belong to the pattern
            many = length[short, f] + 2
            begin = np.cumsum(many) - many
            closed = np.full(int(many.sum()), CLOSE, np.uint8)
            inner = np.arange(int(length[short, f].sum())) - np.repeat(np.cumsum(many - 2) - (many - 2), many - 2)
            closed[np.repeat(begin + 1, many - 2) + inner] = syms[f][np.repeat(at[short], many - 2) + inner]
            lo, hi = ix.search(closed, begin, begin + many)
            found[f].append(np.stack([short, np.full(len(short), -1), lo, hi])[:, hi > lo])
        left = (first == f) & (length[:, f] >= ONE_IN - 1)
        if not left.any():
            continue
        begin, end, text = _pieces(np.where(left, length[:, f], 0), at)
        lo, hi = ix.search(syms[f], begin, end)
        few = np.bincount(text, weights=hi - lo, minlength=n) <= FEW * (length[:, f] // (ONE_IN - 1) + 1)
        found[f].append(np.stack([text, begin - at[text], lo, hi])[:, few[text] & (hi > lo)])
        left &= ~few
        for most in RARE:
            if not left.any():
                break
            hits, enough = _rare(ix, syms[f], at, left, most)
            found[f].append(hits)
            left &= ~enough
        if left.any():
            even = []
            for g in (0, 1):
                begin, end, text = _pieces(np.where(left, length[:, g], 0), fields[g][1])
                lo, hi = ix.search(syms[g], begin, end)
                even.append((np.stack([text, begin - fields[g][1][text], lo, hi]), np.bincount(text, weights=hi - lo, minlength=n)))
            other = (even[1 - f][1] < even[f][1]) & (length[:, 1 - f] > 0)
            for g in (0, 1):
                hits = even[g][0]
                found[g].append(hits[:, (other[hits[0]] == (g != f)) & (hits[3] > hits[2])])
    pairs = [[], []]
    for f in (0, 1):
        text, off, lo, hi = np.concatenate([np.zeros((4, 0), np.int64), *found[f]], 1)
        step = np.cumsum(hi - lo)
        a = 0
        while a < len(step):
            base = step[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(step, base + HITS, "right")))
            own = np.arange(a, b)
            a = b
            many = hi[own] - lo[own]
            which = np.repeat(own, many)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[own], many)
            place = ix.locate(rows)
            d = ix.field(np.where(off[which] < 0, place + 1, place))
            doc, x, shift = d >> 1, text[which], place - ix.starts[d] - off[which]
            here = np.maximum(length[x, f], sh.length[doc, f]) // ONE_IN
            ok = ((d & 1) == f) & (np.abs(shift) <= here)
            doc, x, shift = doc[ok], x[ok], shift[ok]
            for g in (0, 1):
                ok = np.abs(length[x, g] - sh.length[doc, g]) * ONE_IN <= np.maximum(length[x, g], sh.length[doc, g])
                doc, x, shift = doc[ok], x[ok], shift[ok]
            pairs[f].append(np.stack([x, doc, shift]))
    out = []
    for f in (0, 1):
        if not pairs[f]:
            continue
        x, doc, shift = np.concatenate(pairs[f], 1)
        order = np.lexsort((doc, x))
        x, doc, shift = x[order], doc[order], shift[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)  # hits merged by pair; each keeps its diagonals
        last = np.append(first[1:], len(x))
        for a in range(0, len(first), 20_000):
            i, j = x[first[a : a + 20_000]], doc[first[a : a + 20_000]]
            keep = np.ones(len(i), bool)
            for g in (0, 1):
                some_i, at_i = np.unique(i, return_inverse=True)
                some_j, at_j = np.unique(j, return_inverse=True)
                left = _histograms(*codepoints([(s, t)[g][k] for k in some_i.tolist()]))
                right = _histograms(*codepoints([sh.field(k, g) for k in some_j.tolist()]))
                most = np.maximum(length[i, g], sh.length[j, g]) // ONE_IN
                keep &= np.abs(left[at_i] - right[at_j]).sum(1, dtype=np.int64) <= 2 * most
            for k in np.flatnonzero(keep).tolist():
                p, q = int(i[k]), int(j[k])
                if near(t[p], sh.field(q, 1)) and near(s[p], sh.field(q, 0)):
                    own = (s, t)[f][p]
                    cp, _ = codepoints([own])
                    other, _ = codepoints([sh.field(q, f)])
                    out.append((keys[p], sh.keys[q], *matched_spans(cp, other, shift[first[a + k] : last[a + k]].tolist(), min(len(own), 2))))
    return out


_LINKS = "train_key binary, eval_key binary, spans int, covered int"


def near_overlaps(pairs: DataFrame, id_col: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(links, members): links between classes of equal records, and which record is in which class.

    links has (train_key, eval_key, spans, covered): every two classes, one with records in train and the other with
    records in validation or test, whose sources and targets are the same or nearly so: letter case and everything
    but letters and digits aside, at most one character in ten of the longer text differs. spans counts the merged
    maximal matches found in the field searched, covered their letters (0 and 0 for equal records without a letter).
    members has (key, id, evaluation, split). Rows whose source or target is null or blank, and rows of other splits,
    don't count. Splits are compared trimmed and in lower case. A pair of classes comes once.

    Evaluation texts are grouped by the lengths of source and target into shards, and each shard is indexed. Training
    texts lie in files by length; a task loads one shard and streams the files whose lengths can match through
    backward search of it. Of a text with k edits at most, k + 1 disjoint pieces are searched, one of which must stand
    unchanged; hits are merged by pair and checked by the letters' counts and by edit distance.
    """
    spark = pairs.sparkSession
    split = plain_key("split")
    blank = r"\A[\s\p{Z}\p{C}]*\z"
    rows = pairs.filter(split.isin("train", "validation", "test") & F.col("source").isNotNull() & F.col("target").isNotNull())
    rows = rows.filter(~F.regexp_like("source", F.lit(blank)) & ~F.regexp_like("target", F.lit(blank)))
    rows = rows.select(F.col(id_col).alias("id"), split.alias("split"), (split != "train").alias("evaluation"), _norm("source").alias("s"), _norm("target").alias("t"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat("s", F.lit("\1"), "t"))))
    members = materialize(rows.select("key", "id", "evaluation", "split"), "members")
    path = f"{shared_dir(spark)}/loomery-overlap-{uuid.uuid4().hex}"
    classes = rows.groupBy("evaluation", "key").agg(F.first("s").alias("s"), F.first("t").alias("t"))
    classes.withColumn("sc", _length_class("s", _SOURCE_STEPS)).write.partitionBy("evaluation", "sc").parquet(f"{path}/classes")
    classes = spark.read.schema("key binary, s string, t string, evaluation boolean, sc int").parquet(f"{path}/classes").withColumn("tc", _length_class("t", _TARGET_STEPS))

    size = F.length("s") + F.length("t") + 2
    cells = classes.groupBy("evaluation", "sc", "tc").agg(F.sum(size).alias("n")).orderBy("evaluation", "sc", "tc").collect()  # classes of length: a few hundred
    ev, train = ({(r.sc, r.tc): r.n for r in cells if r.evaluation == e} for e in (True, False))
    if not ev or not train:
        return spark.createDataFrame([], _LINKS), members
    most = max(LEAST_SYMBOLS, min(MOST_SYMBOLS, sum(ev.values()) // spark.sparkContext.defaultParallelism))
    plan: list[tuple[int, int, int, int]] = []  # source class, target class, first shard, shards
    shards, used = 0, 0
    for (sc, tc), n in ev.items():
        if used and (used + n > most or sc != plan[-1][0]):
            shards, used = shards + 1, 0
        parts = max(1, math.ceil(n / most))
        plan.append((sc, tc, shards, parts))
        shards, used = shards + parts - 1, used + n if parts == 1 else most
    of = F.broadcast(spark.createDataFrame(plan, "sc int, tc int, _first int, _parts int"))  # as many rows as classes of length
    own = classes.filter("evaluation").join(of, ["sc", "tc"]).select((F.col("_first") + F.pmod(F.xxhash64("key"), "_parts")).cast("int").alias("shard"), "key", "s", "t")
    own.groupBy("shard").applyInPandas(_build, _INDEX).write.partitionBy("shard").parquet(f"{path}/index")

    # a task for each shard and part of the training files that its lengths can match
    reach: dict[int, set[tuple[int, int]]] = {}
    for sc, tc, first, parts in plan:
        near_cells = {c for c in train if abs(c[0] - sc) <= 1 and abs(c[1] - tc) <= 3}
        for k in range(first, first + parts):
            reach.setdefault(k, set()).update(near_cells)
    work = []
    for k, found in sorted(reach.items()):
        parts = max(1, math.ceil(sum(train[c] for c in found) / TASK_SYMBOLS))
        work += [(k, sorted({c[0] for c in found}), p, parts) for p in range(parts) if found]

    def matching(sh: Shard, folders: list[int], part: int, parts: int):
        """The training classes of a part whose lengths can match, SEARCH_ROWS and more at a time, across files."""
        keys, s, t = [], [], []
        files = _dataset([f"{path}/classes/evaluation=false/sc={c}" for c in folders])
        for row_no, batch in enumerate(x for f in files for x in f.to_batches(columns=["key", "s", "t"], batch_size=SEARCH_ROWS)):
            if row_no % parts != part or not batch.num_rows:
                continue
            length = np.stack([pc.utf8_length(batch.column(k)).to_numpy() for k in (1, 2)], 1).astype(np.int64)
            kept = batch.filter(pa.array(sh.may_match(length)))
            for own, column in zip((keys, s, t), kept.columns):
                own += column.to_pylist()
            if len(keys) >= SEARCH_ROWS:
                yield keys, s, t
                keys, s, t = [], [], []
        if keys:
            yield keys, s, t

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                k, folders, part, parts = work[i]
                sh = load_shard(f"{path}/index", k)
                for keys, s, t in matching(sh, folders, part, parts) if sh else ():
                    got = search_shard(sh, keys, s, t)
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], names=["train_key", "eval_key", "spans", "covered"])

    links = spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(run, _LINKS)
    bare = classes.filter("s = '' and t = ''")
    same = bare.filter("not evaluation").select(F.col("key").alias("train_key")).join(bare.filter("evaluation").select(F.col("key").alias("eval_key")), F.col("train_key") == F.col("eval_key"))
    return materialize(links.unionByName(same.withColumns({"spans": F.lit(0), "covered": F.lit(0)})), "links"), members


def overlap_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id_a, pair_id_b): every linked pair of rows, the smaller pair_id first; each pair once.

    Members of a class that holds many rows are spread over SALTS tasks.
    """
    links, members = near_overlaps(pairs)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt")
    train = members.filter("not evaluation").select(F.col("key").alias("train_key"), F.col("id").alias("a"), salt)
    ev = members.filter("evaluation").select(F.col("key").alias("eval_key"), F.col("id").alias("b"))
    spread = links.select("train_key", "eval_key").join(ev, "eval_key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = spread.join(train, ["train_key", "_salt"]).filter("a <> b")
    return both.select(F.least("a", "b").alias("pair_id_a"), F.greatest("a", "b").alias("pair_id_b")).distinct()


def overlap_report(pairs: DataFrame) -> DataFrame:
    """(split, origin, rows, overlapping): evaluation rows, and how many of them also stand in train."""
    links, members = near_overlaps(pairs)
    hit = members.filter("evaluation").join(links.select(F.col("eval_key").alias("key")).distinct(), "key").select(F.col("id").alias("pair_id"), F.lit(1).alias("hit")).distinct()
    ev = pairs.select("pair_id", plain_key("split").alias("split"), "origin").filter("split in ('validation', 'test')")
    return ev.join(hit, "pair_id", "left").groupBy("split", "origin").agg(F.count("*").alias("rows"), F.count("hit").alias("overlapping"))
