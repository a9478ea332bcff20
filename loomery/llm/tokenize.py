"""Problem 7: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """(id, ids): the ids of every text, special tokens' strings read as plain text; with ``offsets`` also
    (offsets), the byte of the text at which each id begins.

    Null and empty texts give empty lists. Nothing is shuffled: batches are encoded where they are read.
    """
    path = path or bpe.ranks_path()
    names = [id_col, "ids", "offsets"] if offsets else [id_col, "ids"]

    def run(batches):
        enc = bpe.encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in bpe.blocks(texts):
                values, at, places = enc.encode([t or "" for t in texts[a:b]])
                at = pa.array(at.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((values, places) if offsets else (values,))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *lists], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", offsets array<int>" * offsets)


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and n_tokens, the number of ids of the text (0 for null and empty texts)."""
    path = path or bpe.ranks_path()
    names = [*keep, "n_tokens"]

    def run(batches):
        enc = bpe.encoder(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in bpe.blocks(texts):
                n = pa.array(enc.count([t or "" for t in texts[a:b]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), n], names=names)

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text_col), *keep).mapInArrow(run, f"{shape}, n_tokens int")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text) of what encode_corpus gave with offsets; the round trip is exact. Ids and offsets that don't belong
    together are an error; null lists count as empty ones."""
    path = path or bpe.ranks_path()

    def run(batches):
        enc = bpe.encoder(path)
        for batch in batches:
            ids, places = ([np.asarray(x or [], np.int64) for x in batch.column(k).to_pylist()] for k in (1, 2))
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            texts = enc.decode(np.concatenate([np.zeros(0, np.int64), *ids]), at, np.concatenate([np.zeros(0, np.int64), *places]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids", "offsets").mapInArrow(run, f"`{id_col}` {kind}, text string")
