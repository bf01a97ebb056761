"""Repeated passages by sliding spans of sentences.

A sentence ends at ``.``, ``!``, ``?`` or a line end; one of more than ``LONG`` words is cut further after words picked
by their own hash, so that equal passages are cut alike wherever they stand (and after every ``LONG`` words where none
is picked for long, as in one word over and over). From each sentence on, the run of
consecutive sentences that first reaches ``least_words`` words is hashed (a sentence that long is a run by itself). All
runs of all documents meet by hash; a sentence is removed where a run that covers it is not the first with its hash.

A text is parsed once for its runs, which are written with its numbers of words and sentences, and again only where
something is removed from it. Runs are unique within a document and summed up to (hash, first, last document) before
they are shuffled. A bit table of fixed size then keeps runs that occur once from being shuffled again; where it fills
up it only filters less. Hashes of passages in more than one document in ``OFTEN`` are looked up in a table that is sent
to the workers: a document has so many runs, so there are at most ``OFTEN`` times the mean number of runs of these. So
no task gets a frequent passage's documents.

Documents are in the order of their ids, rows with equal ids in that of their texts' hashes, and null ids come last;
rows that are equal in both are in an order of their own. Null texts are empty: no sentences. Texts with fewer than
``least_words`` words have no runs and stay whole, as do the first of equal texts. An empty table gives no rows. A text
of any length costs memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import id_and_text, table, written
from veridex.llm.decontamination import NORMAL

SCHEMA = "doc_id long, n_words long, n_sentences long, n_removed long, removed_words long, text string"
LONG, CUT = 12, 8
#: ASCII as in NORMAL, but for the ends of sentences, which become one mark.
MARKED = bytes(1 if c in b".!?\n" else NORMAL[c] for c in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
BITS, SLICES = 1 << 26, 64
#: A hash in more than one document in so many, and in more than ``OFTEN``, is frequent.
OFTEN = 1000
BASE, UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Spans:
    """Sentences and runs of texts; keeps word hashes and powers for the next texts."""

    def __init__(self, limit: int = 250_000):
        self.limit, self.known = limit, {}
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                size = max(2 * len(self.up), n + 1)
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64) for b in (BASE, UNBASE))

    def of(self, text: str, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the sentences (in words); and for each run its hash, first and last sentence."""
        tokens = text.encode("utf-8", "replace").translate(MARKED).replace(b"\x01", b" \x01 ").split()
        known = self.known
        if len(known) > self.limit:
            known.clear()
        known[b"\x01"] = 0
        for w in tokens:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) | 1
        value = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        at = np.flatnonzero(value)
        n = len(at)
        none = np.zeros(0, np.int64)
        if not n:
            return none, none, none, none
        value = value[at]
        cut = np.r_[np.diff(at) > 1, True]
        size = np.diff(np.r_[-1, np.flatnonzero(cut)])
        cut |= np.repeat(size > LONG, size) & ((value >> np.uint64(32)) % np.uint64(CUT) == 0)
        ends = np.flatnonzero(cut) + 1
        size = np.diff(np.r_[0, ends])
        if (size > 2 * LONG).any():
            nth = np.arange(1, n + 1) - np.repeat(ends - size, size)
            cut |= np.repeat(size > 2 * LONG, size) & (nth % LONG == 0)
            ends = np.flatnonzero(cut) + 1
        starts = np.r_[0, ends[:-1]]
        last = np.searchsorted(ends, starts + least_words)
        ok = last < len(ends)
        first = np.flatnonzero(ok)
        last = last[ok]
        self._powers(n)
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(value * self.up[:n], dtype=np.uint64)]
            s, e = starts[first], ends[last]
            h = (total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ends, (h ^ (h >> np.uint64(29))).view(np.int64), first, last


_spans = Spans()


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, in a table of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, any_ = np.zeros(BITS, bool), False
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)] = any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in np.packbits(bits).reshape(SLICES, -1)], pa.binary())], ["slice", "bits"])

    def join(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8 // SLICES, np.uint8)
        for batch in rows:
            for blob in batch.column("bits"):
                bits |= np.frombuffer(blob.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])

    schema = "slice int, bits binary"
    found = np.zeros((SLICES, BITS // 8 // SLICES), np.uint8)
    for r in hashes.mapInArrow(mark, schema).groupBy("slice").applyInArrow(join, schema).collect():
        found[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return found.ravel()


def _ordered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: ``row`` is the document's place in the order, its id where all ids are there and differ."""
    if docs.filter("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.select(F.col("doc_id").alias("row"), "doc_id", "text")
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc())
    return written(docs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "ordered")


def _parsed(docs: DataFrame, least_words: int) -> DataFrame:
    """``row, n_words, n_sentences, again`` (whether it repeats a run of its own) and ``h``: its distinct runs' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ends, h, _, _ = _spans.of(text, least_words)
                distinct = np.unique(h)
                out.append((int(ends[-1]) if len(ends) else 0, len(ends), len(distinct) < len(h), distinct.tobytes()))
            words, sentences, again, h = zip(*out) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(sentences, pa.int64()), pa.array(again, pa.bool_()), pa.array(h, pa.binary())], ["row", "n_words", "n_sentences", "again", "h"])

    return written(docs.select("row", "text").mapInArrow(run, "row long, n_words long, n_sentences long, again boolean, h binary"), "runs")


def _repeated(parsed: DataFrame) -> DataFrame:
    """``row, later``: hashes of the row's runs, as bytes, that an earlier row has, too; rows without any are left out."""
    spark = parsed.sparkSession

    def runs(keep=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    rows, blobs = batch.slice(at, 2000).column(0).to_numpy(), [memoryview(x.as_buffer()) for x in batch.slice(at, 2000).column(1)]
                    h, row = np.frombuffer(b"".join(blobs), np.int64), np.repeat(rows, [len(b) // 8 for b in blobs])
                    if keep is not None:
                        on = keep(h)
                        h, row = h[on], row[on]
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(row)], ["h", "row"])

        return parsed.select("row", "h").mapInArrow(run, "h long, row long")

    found = written(runs().groupBy("h").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("n")).filter("first < last").select("h", "first", "n"), "repeated")
    most = max(OFTEN, parsed.count() // OFTEN)
    frequent = found.filter(F.col("n") > most).select("h", "first").orderBy("h").collect()  # few, see above
    hot = spark.sparkContext.broadcast((np.array([r["h"] for r in frequent], np.int64), np.array([r["first"] for r in frequent], np.int64)))
    rare = found.filter(F.col("n") <= most).select("h", "first")
    bits = spark.sparkContext.broadcast(_bits(rare.select("h")))

    def marked(h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) % np.uint64(BITS)
        return (bits.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, first = hot.value
        for batch in batches:
            rows, later = [], []
            for row, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.frombuffer(blob.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                if (yes := (hashes[at] == h) & (first[at] < row)).any():
                    rows.append(row)
                    later.append(h[yes])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(later, pa.list_(pa.int64()))], ["row", "later"])

    later = runs(marked).join(rare, "h").filter("row > first").groupBy("row").agg(F.collect_list("h").alias("later"))
    if frequent:
        every = later.union(parsed.select("row", "h").mapInArrow(looked_up, "row long, later array<bigint>"))
        later = every.groupBy("row").agg(F.flatten(F.collect_list("later")).alias("later"))
    return later


def without_repeats(df: DataFrame, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCHEMA`` of every row: its words and sentences, how many of them are repeats, and the text without these."""
    docs = _ordered(id_and_text(df, id_col, text_col))
    parsed = _parsed(docs, least_words)

    def cut(text: str, hashes: np.ndarray) -> tuple[int, int, str]:
        ends, h, first, last = _spans.of(text, least_words)
        again = np.ones(len(h), bool)
        again[np.unique(h, return_index=True)[1]] = False
        again |= np.isin(h, hashes)
        edge = np.zeros(len(ends) + 1, np.int64)
        np.add.at(edge, first[again], 1)
        np.subtract.at(edge, last[again] + 1, 1)
        gone = np.cumsum(edge[:-1]) > 0
        starts = np.r_[0, ends[:-1]]
        at = np.fromiter((m.start() for m in WORD.finditer(text)), np.int64, int(ends[-1]))
        bounds = np.r_[at[starts], len(text)].tolist()
        kept = text[: bounds[0]] + "".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~gone).tolist())
        return int(gone.sum()), int((ends - starts)[gone].sum()), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, again, hashes in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                out.append(cut(text, hashes.values.to_numpy() if hashes.is_valid else np.zeros(0, np.int64)) if again or hashes.is_valid else (0, 0, text))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    found = parsed.drop("h").join(_repeated(parsed), "row", "left")
    return docs.join(found, "row").select("doc_id", "n_words", "n_sentences", "text", "again", "later").mapInArrow(run, SCHEMA)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
