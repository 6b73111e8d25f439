"""Cost-balanced packing of tokenized documents into fixed-length training sequences.

Every document becomes token ids plus an end id.  One streaming pass over the scan packs each
task's documents in groups of a bounded number of tokens: whole ``capacity`` pieces of a long
document are sequences of their own, and the rest of each document goes, longest first, to the
sequence with the least estimated cost (``linear * tokens + quadratic * sum of squared piece
lengths``, the price of attention inside documents) that still has room for it.  A document no
sequence has room for is cut: the cheapest sequence with any room takes its share.  A group gets
as many sequences as its tokens fill and, for the remainder, sequences whose lengths are powers of
two, so nothing needs padding.

Nothing is shuffled, so a hot source or group of copies costs no task more than its share of the
scan, and a task that runs again on another executor reads the same split and packs it alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import query, table, text_of
from lorekeep.llm.tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 1 << 21  # tokens that one greedy assignment sees: 8 MB of ids
FLUSH_BYTES = 16 << 20  # ids per output batch

def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` of items shorter than ``capacity``."""
    total = int(lengths.sum())
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    left = np.array(room, np.int64)
    cost = np.zeros(len(room))
    pieces = []
    for item in np.argsort(-lengths, kind="stable"):
        start, rest = 0, int(lengths[item])
        while rest:
            fits = np.flatnonzero(left >= rest)
            open_ = fits if len(fits) else np.flatnonzero(left)
            seq = open_[np.argmin(cost[open_])]
            n = min(rest, int(left[seq]))
            pieces.append((int(item), start, n, int(seq), room[seq] - int(left[seq])))
            left[seq] -= n
            cost[seq] += linear * n + quadratic * n * n
            start, rest = start + n, rest - n
    return pieces


def pack(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: the document's id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and the piece's ``ids`` (little-endian unsigned 32-bit).

    Null and empty texts are one end id.  A null id stays null; repeated rows are packed each.  Ties
    in length keep scan order and ties in cost go to the earlier sequence.  An empty table gives no
    rows; other columns are ignored.
    """
    schema = T.StructType([
        docs.schema[doc_id], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = encoder(tokenizer_path)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 33
        out: list[tuple] = []
        out_bytes = 0
        group: list[tuple] = []  # (id, start of the rest, rest of the ids, tokens of the document)
        group_size = 0

        def flush():
            nonlocal out, out_bytes
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:6]], pa.array(columns[6], pa.binary())]
            out, out_bytes = [], 0
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        def pack_group():
            nonlocal next_id, group, group_size, out_bytes
            lengths = np.array([len(g[2]) // 4 for g in group], np.int64)
            last = -1
            for item, start, n, seq, offset in balance(lengths, capacity, linear, quadratic):
                key, base, ids, tokens = group[item]
                out.append((key, base + start, n, tokens, next_id + seq, offset, ids[4 * start:4 * (start + n)]))
                out_bytes += 4 * n
                last = max(last, seq)
            next_id += last + 1
            group, group_size = [], 0

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens_of.encode(value.as_py()) + end
                tokens, start = len(ids) // 4, 0
                while tokens - start >= capacity:
                    out.append((key, start, capacity, tokens, next_id, 0, ids[4 * start:4 * (start + capacity)]))
                    next_id, start, out_bytes = next_id + 1, start + capacity, out_bytes + 4 * capacity
                    if out_bytes >= FLUSH_BYTES:
                        yield flush()
                if start < tokens:
                    group.append((key, start, ids[4 * start:], tokens))
                    group_size += tokens - start
                if group_size >= group_tokens:
                    pack_group()
                if out_bytes >= FLUSH_BYTES:
                    yield flush()
        if group:
            pack_group()
        if out:
            yield flush()

    return docs.select(doc_id, text_of(text).alias("text")).mapInArrow(run, schema)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op8_cost_balanced_packing")
def op8(spark, sf_dir):
    pieces = with_checksums(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
