"""Benchmark passages in documents by Wu-Manber search over words.

A window is a run of ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. For
windows of one length m, a block is their last words up to three. The shift table has, for each block within any
window, how far the window's end may still be; a block in no window lets the search skip m - 2 words. Where the shift
is 0 the block's bucket holds the windows that end in it, and comparing all their words confirms an occurrence.

Items are sent to the workers in blocks of bounded size (``block_bytes`` of text). More than one block costs a pass each,
whose result is written before the next block is fetched: the driver and the workers hold one block, however many items
there are. Every document is searched whole.

Null texts of documents or items have no words. Equal item ids count once; items with a null id mark words as hit but
aren't listed. Rows with equal or null document ids are searched one by one. Without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import _quoted, id_and_text, table, written

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: A-Z lower-cased; ASCII other than letters and digits separates words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split()


class WindowSearch:
    """Shift tables and buckets for the windows of some items, by window length."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = 10):
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = words_of(text)
            m = min(window, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                found.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
        self.tables = []
        for m, windows in sorted(found.items()):
            size = min(3, m)
            shift: dict[tuple, int] = {}
            bucket: dict[tuple, dict[tuple, set]] = {}
            for words, ids in windows.items():
                for end in range(size, m + 1):
                    block = words[end - size : end]
                    shift[block] = min(m - end, shift.get(block, m))
                bucket.setdefault(words[m - size :], {})[words] = ids
            self.tables.append((m, size, shift, bucket))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """Begin, end and items of every window in ``words``."""
        n = len(words)
        for m, size, shift, bucket in self.tables:
            far, at = m - size + 1, m
            while at <= n:
                block = tuple(words[at - size : at])
                step = shift.get(block, far)
                if step:
                    at += step
                    continue
                items = bucket[block].get(tuple(words[at - m : at]))
                if items is not None:
                    yield at - m, at, items
                at += 1


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items one block after another, from a written table, so that they are the same in each pass; the driver holds what
    is in one of its files at a time."""
    block, size = [], 0
    for r in written(id_and_text(items, id_col, text_col).filter("text <> ''"), "items").toLocalIterator():
        block.append((r["doc_id"], r["text"]))
        size += len(r["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_searches: dict[str, WindowSearch] = {}


def _search(key: str, items: list, window: int) -> WindowSearch:
    """The worker's tables for a block; those of one block stay."""
    if key not in _searches:
        _searches.clear()
        _searches[key] = WindowSearch(items, window)
    return _searches[key]


def _with_occurrences(df: DataFrame, text_at: int, items: list, window: int) -> DataFrame:
    """Adds to the last two columns the occurrences of a block's windows: ``spans`` (int64 pairs) and ``found``."""
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "replace")).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(items)  # of a block's size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(key, sent.value, window)
        for batch in batches:
            spans, found = (c.to_pylist() for c in batch.columns[-2:])
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                got = list(search.occurrences(words_of(text or "")))
                if got:
                    spans[k] += np.array([g[:2] for g in got], np.int64).tobytes()
                    found[k] = sorted(set(found[k]).union(*(g[2] for g in got)) - {None})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, pa.binary()), pa.array(found, pa.list_(pa.int64()))], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def occurrences(df: DataFrame, items: DataFrame, text_col: str, window: int, block_bytes: int, item_id_col: str, item_text_col: str) -> DataFrame:
    """``df`` and the columns ``spans`` and ``found``; their names end in underscores where ``df`` has them already."""
    names = []
    for name in ("spans", "found"):
        while name.lower() in map(str.lower, df.columns):
            name += "_"
        names.append(name)
    out = df.select(*map(_quoted, df.columns), F.lit(b"").alias(names[0]), F.lit([]).cast("array<bigint>").alias(names[1]))
    for k, block in enumerate(item_blocks(items, item_id_col, item_text_col, block_bytes)):
        out = _with_occurrences(written(out, "occurrences") if k else out, df.columns.index(text_col), block, window)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``SCHEMA`` of every document; no shuffle. ``n_hit``: words inside any occurrence of any window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, spans, found = batch.columns
            n_words = [len(words_of(t)) for t in text.to_pylist()]
            n_hit = [0] * len(n_words)
            for k, raw in enumerate(spans.to_pylist()):
                if raw:
                    edge = np.zeros(n_words[k] + 1, np.int64)
                    pairs = np.frombuffer(raw, np.int64).reshape(-1, 2)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.subtract.at(edge, pairs[:, 1], 1)
                    n_hit[k] = int((np.cumsum(edge) > 0).sum())
            names = [sorted(map(str, f)) for f in found.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return occurrences(id_and_text(docs, id_col, text_col), items, "text", window, block_bytes, item_id_col, item_text_col).mapInArrow(run, SCHEMA)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 4_000_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs."""
    found = occurrences(docs, items, text_col, window, block_bytes, item_id_col, item_text_col)
    spans, ids = found.columns[-2:]
    return found.filter(F.length(spans) == 0).drop(spans, ids)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
