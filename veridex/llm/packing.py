"""Concatenate and cut: documents as one stream of ids, cut into fixed windows.

First pass: each partition encodes its documents once and writes ids with the number of ids before each document in
the partition. The partitions' totals (one small row per partition) are summed up to each partition's global offset.
Second pass: every document knows its global offset and is cut at multiples of the window; a document that crosses a
boundary leaves a piece on each side, so windows span documents and partitions without any shuffle.

Null texts are empty: such a document is its end id alone. Rows with equal or null ids are documents of their own. An
empty table gives no piece. All windows but the last are full. A document of any length may span many windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import id_and_text, table, tokenizer_path, written
from veridex.llm.encoders import encoder

ENCODED = "doc_id long, part int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """First pass over ``doc_id, text``: a table of ids (little-endian uint32) by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, before = encoder(path).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                ids = [x + end for x in ids_of(some.column(1).to_pylist())]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "before", "n", "ids"],
                )

    return docs.mapInArrow(run, ENCODED)


def offsets_of(parts: DataFrame) -> dict[int, int]:
    """Global offset of each partition from ``part, before, n``: one row per partition reaches the driver."""
    totals = parts.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).orderBy("part").collect()
    offsets, at = {}, 0
    for r in totals:
        offsets[r["part"]] = at
        at += r["total"]
    return offsets


def packed(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document lie where in which window (``PIECES``; with ``with_ids`` also
    ``ids`` as little-endian uint32 bytes). ``ids_crc32`` is of the piece's ids in that form."""
    if window < 1:
        raise ValueError("window must be at least 1")
    ids = written(encoded(id_and_text(df, id_col, text_col), tokenizer_path(tokenizer), end_id), "packing")
    offsets = offsets_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                yield cut(batch.slice(at, 1000))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, part, before, n, blobs = batch.columns
        first = np.array([offsets[p] for p in part.to_pylist()], np.int64) + before.to_numpy()
        n = n.to_numpy()
        pieces = (first + n - 1) // window - first // window + 1
        row = np.repeat(np.arange(len(n)), pieces)
        sequence = first[row] // window + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.maximum(first[row], sequence * window)
        stop = np.minimum((first + n)[row], (sequence + 1) * window)
        start = begin - first[row]
        content = [memoryview(b.as_buffer()) for b in blobs]
        cuts = [content[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), (stop - first[row]).tolist())]
        columns = [doc.take(pa.array(row)), *map(pa.array, (start, stop - begin)), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), *map(pa.array, (n[row], sequence, begin - sequence * window))]
        names = [x.split()[0] for x in PIECES.split(", ")]
        if with_ids:
            columns.append(pa.array([bytes(c) for c in cuts], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    return ids.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
