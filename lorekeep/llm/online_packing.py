"""Bounded-space online best-fit packing of tokenized documents.

A document is token ids plus an end id.  One of at most ``capacity`` tokens stays whole; only a
longer one is cut, into ``capacity`` pieces of which the first is what is left over.  Full pieces are
sequences of their own.  Every other piece goes, as it comes, to the open sequence with the least room
that still holds it.  ``open_bins`` sequences may be open at a time: where a new one is needed and none may
be opened, the fullest closes for good.  A sequence without room closes at once.

Open sequences are kept by their free space, and a bitset has a bit for every free space that some open
sequence has: the best fit for ``n`` tokens is its lowest bit at ``n`` or above, the fullest its lowest bit
of all.  A sequence is only a number and its free space, as pieces leave as soon as they are placed, so a
task holds ``open_bins`` numbers and one batch of output, whatever it reads.

Every task of the scan is a stream of its own and nothing is shuffled: a hot source or group of copies costs
a task no more than its share of the scan, and a task that runs again reads the same split and packs it
alike.  Each task may end with sequences that are not full, as any stream does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import query, table, text_of
from lorekeep.llm.tokens import default_tokenizer, encoder

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 4096
FLUSH_BYTES = 16 << 20  # ids per output batch


class OpenSequences:
    """The open sequences of one stream."""

    def __init__(self, capacity: int, open_bins: int, first_id: int = 0):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be 1 or more")
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some open sequence has room for r tokens
        self.n_open = 0

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``length`` tokens, 1 to ``capacity``.  Of sequences with
        the same room the one that got its last piece latest is taken."""
        fitting = self.rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(room)
        else:
            if length < self.capacity and self.n_open == self.open_bins:
                self._take((self.rooms & -self.rooms).bit_length() - 1)
            room, sequence = self.capacity, self.next_id
            self.next_id += 1
        left = room - length
        if left:
            self.by_room[left].append(sequence)
            self.rooms |= 1 << left
            self.n_open += 1
        return sequence, self.capacity - room

    def _take(self, room: int) -> int:
        held = self.by_room[room]
        sequence = held.pop()
        if not held:
            self.rooms ^= 1 << room
        self.n_open -= 1
        return sequence


def cuts(tokens: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document."""
    start, length = 0, tokens % capacity or capacity
    while start < tokens:
        yield start, length
        start, length = start + length, capacity


def pack_online(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS,
) -> DataFrame:
    """One row per piece: the document's id, ``piece``, ``start``, ``length``, ``sequence_id``, ``offset``
    and the piece's ``ids`` (little-endian unsigned 32-bit).

    Null and empty texts are one end id.  A null id stays null, and repeated rows are packed each.  An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    schema = T.StructType([
        docs.schema[doc_id], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = encoder(tokenizer_path)
        context = TaskContext.get()
        bins = OpenSequences(capacity, open_bins, (context.partitionId() if context else 0) << 33)
        out: list[tuple] = []
        out_bytes = 0

        def flush():
            nonlocal out, out_bytes
            columns = list(zip(*out))
            types = [id_type, pa.int32(), *[pa.int64()] * 4, pa.binary()]
            out, out_bytes = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens_of.encode(value.as_py()) + end
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    out.append((key, piece, start, length, *bins.place(length), ids[4 * start:4 * (start + length)]))
                    out_bytes += 4 * length
                    if out_bytes >= FLUSH_BYTES:
                        yield flush()
        if out:
            yield flush()

    return docs.select(doc_id, text_of(text).alias("text")).mapInArrow(run, schema)


@query("op11_online_best_fit")
def op11(spark, sf_dir):
    pieces = pack_online(table(spark, sf_dir, "documents"), default_tokenizer())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
