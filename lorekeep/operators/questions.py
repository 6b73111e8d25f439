"""Question tables of any size against a corpus: blocks that meet in the tasks.

Questions become blocks, rows that hold a packed Arrow batch of ``VECTOR_BYTES`` or ``TEXT_BYTES``.  Every corpus row
meets every question block, which is the whole work of ranking a stated set of questions against all rows; what
is emitted are best lists.

Question blocks whose checked size fits are broadcast, and the corpus does not move: up to ``FEW_BLOCKS`` come
once to a task, with its first corpus row, which is copied as often; for more of them corpus rows become blocks too, of
``CORPUS_BYTES``.  Others are dealt out: they are copied to every one of a bounded number of slots, corpus blocks go
to a slot each, and past ``GROUP_BYTES`` of questions both go by group too, so that a task holds one group of questions.
The corpus is scanned once in any case, and no question comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.joins import fits_broadcast
from lorekeep.operators.topk import SCAN_TASKS, SCORED, TASKS_PER_CORE
from lorekeep.session import staged

VECTOR_BYTES, TEXT_BYTES = 128 << 10, 128 << 10
CORPUS_BYTES, CORPUS_ROWS = 2 << 20, 4096
GROUP_BYTES = 64 << 20
FEW_BLOCKS = 16
HELD_ROWS = 2_000_000  # rows of best lists a task holds before it hands them on
IN_TASK = (1 << 33) - 1  # the bits of ``monotonically_increasing_id`` that number the rows of a task


def _parts(batch: pa.RecordBatch, limit: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes."""
    step = max(1, min(most_rows, limit * len(batch) // max(1, batch.nbytes)))
    return (batch.slice(low, step) for low in range(0, len(batch), step))


def packed(df: DataFrame, column: str, limit: int, most_rows: int) -> DataFrame:
    """One row, one binary ``column``, per run of about ``limit`` bytes of rows; a single longer row is a
    block of its own.  Rows stay in their task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, limit, most_rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [column])

    return df.mapInArrow(run, f"{column} binary")


def _unpacked(payload: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload.as_buffer()).read_next_batch()


def rank_in_blocks(
    questions: DataFrame, corpus: DataFrame, block: Callable[[pa.RecordBatch], object], question_bytes: int,
) -> DataFrame:
    """Best rows (``query_id, knowledge_id, score``) of every question, per task.

    ``block(questions)`` makes a scorer with ``push(corpus rows)``, ``held`` rows and ``to_batch()``.  Question ids
    are distinct."""
    asked = staged(packed(questions, "asked", question_bytes, 1 << 20).withColumn("number", F.monotonically_increasing_id()), "question_blocks")
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    rows = corpus.coalesce(max(SCAN_TASKS, TASKS_PER_CORE * cores))
    small = fits_broadcast(asked)
    if small and asked.count() <= FEW_BLOCKS:
        return _ranked_row_by_row(asked, rows, block)
    rows = packed(rows, "rows", CORPUS_BYTES, CORPUS_ROWS).withColumn("place", F.monotonically_increasing_id())
    if small:
        keys, asked = ["group"], F.broadcast(asked.withColumn("group", F.pmod("number", F.lit(1))))
        rows = rows.withColumn("group", F.pmod("place", F.lit(1)))
    else:
        held = asked.agg(F.coalesce(F.sum(F.octet_length("asked")), F.lit(0))).first()[0]
        groups = max(1, -(-held // GROUP_BYTES))
        slots = min(SCAN_TASKS, TASKS_PER_CORE * cores)
        keys, asked = ["group", "slot"], asked.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups))).withColumn(
            "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        rows = rows.withColumn("slot", F.pmod(F.xxhash64("place"), F.lit(slots))).withColumn(
            "group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: dict[int, object] = {}
        place, part = None, None
        for batch in batches:
            for i in range(len(batch)):
                number, at = batch.column("number")[i].as_py(), batch.column("place")[i].as_py()
                if at != place:
                    place, part = at, _unpacked(batch.column("rows")[i])
                if number not in scorers:
                    scorers[number] = block(_unpacked(batch.column("asked")[i]))
                scorers[number].push(part)
                if sum(s.held for s in scorers.values()) > HELD_ROWS:
                    yield from (s.to_batch() for s in scorers.values())
                    scorers = {}
        yield from (s.to_batch() for s in scorers.values())

    return rows.join(asked, keys).mapInArrow(run, SCORED)


def _ranked_row_by_row(asked: DataFrame, rows: DataFrame, block: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """The first row of a task is joined with every question block, the others with none: one Python process a task
    reads plain rows, where packing them takes a second one and a copy for every question block."""
    first = F.when(F.monotonically_increasing_id().bitwiseAND(IN_TASK) == 0, F.lit(0).cast("long"))
    told = rows.withColumn("first", first).join(F.broadcast(asked.select("asked", F.pmod("number", F.lit(1)).alias("first"))), "first", "left")
    return told.select("asked", *rows.columns).mapInArrow(lambda batches: best_lists(batches, block), SCORED)


def best_lists(batches: Iterator[pa.RecordBatch], block: Callable[[pa.RecordBatch], object]) -> Iterator[pa.RecordBatch]:
    """Corpus rows in order, of which copies of the first hold a question block each in column ``asked``."""
    questions, scorers, held = [], [], []
    for batch in batches:
        told, rows = batch.column(0), batch.select(batch.schema.names[1:])
        begins = len(batch) - told.null_count
        for i in range(begins):
            questions.append(_unpacked(told[i]))
            scorers.append(block(questions[-1]))
            scorers[-1].push(rows.slice(i, 1))
            held.append(scorers[-1].held)
        for part in _parts(rows.slice(begins), CORPUS_BYTES, CORPUS_ROWS):
            for i in range(len(scorers)):
                scorers[i].push(part)
                held[i] = scorers[i].held
                if sum(held) > HELD_ROWS:
                    yield from (s.to_batch() for s in scorers)
                    scorers, held = [block(q) for q in questions], [0] * len(questions)
    yield from (s.to_batch() for s in scorers)
