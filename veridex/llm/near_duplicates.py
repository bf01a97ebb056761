"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (lower case, ASCII letters and digits and all other characters beyond ASCII; a
shorter text is one shingle). A shingle's weight is its count in the text times its inverse document frequency, from 1
for all that are rarer than one document in ``RARE`` down to about 0.1 for one in all documents, in ``LEVELS`` steps. A
group of copies counts as one document, however large it is, or its own shingles would be called frequent: a bitmap
(Flajolet and Martin 1985) for each of ``COUNTERS`` hashed shingles counts the distinct least shingles of the documents
that have it, and copies mostly share theirs. A counter's load by other shingles and ``RARE`` both grow in proportion to
the corpus, so the weights mean the same at every size.

Each text gets ``BANDS * ROWS`` samples (Ioffe 2010); a sample's logarithm is the sum of one table entry by shingle and
one by shingle and weight, and its least value over the text stands for the sampled shingle and step. Texts that share
all samples of a band meet in a bucket. Buckets with the same members count once. A bucket's members are dealt by hash
to packs of about ``PACK``, and all pairs of a pack are compared by one matrix product, exactly, by weighted Jaccard
similarity. That settles buckets of one pack. In larger ones a few representatives of each class and bucket are dealt
anew and compared until that joins nothing more; then every member outside its bucket's largest class is compared with
all other members, pack against pack. So each pair that shares a bucket is compared, unless both are in one class
already, and no task holds more than two packs. Classes are the connected components of the links.

A pair at the threshold shares no bucket with a probability of about 1 in 10,000 (``BANDS``, ``ROWS``).

Null texts are empty. Texts with equal words, or with none, are copies of each other. Rows with equal or null ids are
rows of their own; a class is named by its smallest id (null if it has none). An empty table gives no rows. A text of any
length is read whole, and costs memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import _quoted, alone, id_and_text, table, written
from veridex.llm.components import relabelled
from veridex.llm.decontamination import words_of

SHINGLE, BANDS, ROWS = 5, 18, 4
#: Members of a pack, about; representatives of a class in a bucket.
PACK, REPRESENTATIVES = 128, 4
#: Bitmaps of the document frequencies, of 32 bits each; their levels, a byte each, are all that is sent to every worker.
COUNTERS, SLICES = 1 << 22, 64
#: One document in so many, and at least this number, is rare.
RARE, LEAST_RARE = 2000, 16
LEVELS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that few texts or sets are Python's at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts, in order; a word's hash is kept for the next texts."""

    def __init__(self, limit: int = 150_000):
        self.limit, self.known = limit, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        value = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(words))
        if not n:
            return value
        with np.errstate(over="ignore"):
            h = value[: len(words) - n + 1].copy()
            for k in range(1, n):
                h = h * BASE + value[k : len(words) - n + 1 + k]
        return mixed(h)


class Sampler:
    """The samples' two tables: -ln c by the low bits of a shingle, and what r and beta make of a weight by others."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.log_c = np.log(rng.gamma(2.0, size=(1 << 14, samples))).astype(np.float32)
        self.r = rng.gamma(2.0, size=(1 << 11, samples))
        self.beta = rng.random((1 << 11, samples))
        self.step = np.stack([self._step(np.arange(1 << 11), np.log(k / LEVELS)) for k in range(1, LEVELS + 1)], 1).reshape(-1, samples)

    def _step(self, row: np.ndarray, log_weight: np.ndarray | float) -> np.ndarray:
        r, beta = self.r[row], self.beta[row]
        t = np.floor(np.asarray(log_weight)[..., None] / r + beta)
        return (-r * (t - beta) - r).astype(np.float32)

    def bands(self, h: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """64-bit values of the bands of a text's distinct shingles with their counts and levels (1 to ``LEVELS``)."""
        least = np.full(self.log_c.shape[1], np.inf, np.float32)
        for at in range(0, len(h), 4096):
            x, n, level = h[at : at + 4096], counts[at : at + 4096], levels[at : at + 4096].astype(np.int64)
            row = (x >> np.uint64(20) & np.uint64(0x7FF)).astype(np.int64)
            log_c = self.log_c[(x >> np.uint64(40) & np.uint64(0x3FFF)).astype(np.int64)]
            log_a = self.step[row * LEVELS + level - 1] + log_c
            more = np.flatnonzero(n > 1)
            if len(more):
                log_a[more] = self._step(row[more], np.log(level[more] * n[more] / LEVELS)) + log_c[more]
            np.minimum(least, log_a.min(axis=0), out=least)
        rows = mixed(least.view(np.uint32).astype(np.uint64)).reshape(BANDS, -1)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(rows.shape[1]):
            out = mixed(out * BASE + rows[:, k])
        return out.view(np.int64)


_shingler, _samplers = Shingler(), []


def _sampler() -> Sampler:
    if not _samplers:
        _samplers.append(Sampler())
    return _samplers[0]


def _counters(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def document_bitmaps(texts: DataFrame) -> np.ndarray:
    """A bitmap for each counter, over all texts: bits of the texts' least shingles, the k-th with probability 2^-k.

    A task's bitmaps are joined in slices, in two steps; ``COUNTERS`` of them reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part, seen = np.zeros(COUNTERS, np.uint32), 0, False
        for batch in _parts(batches):
            for text in batch.column(0).to_pylist():
                h = _shingler.hashes(words_of(text))
                if len(h):
                    kind = int(mixed(h.min() ^ BASE))
                    bits[_counters(h)] |= np.uint32(min(kind & -kind, 1 << 31))
                    part = (part * 31 + len(h)) % 64
                    seen = True
        if seen:
            slices = [pa.compress(s.tobytes(), "lz4", asbytes=True) for s in bits.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int32()), pa.array(slices, pa.binary())], ["slice", "part", "bits"])

    def unpacked(blob: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, COUNTERS // SLICES * 4, "lz4", asbytes=True), np.uint32)

    def join(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(COUNTERS // SLICES, np.uint32)
        for batch in rows:
            for blob in batch.column("bits").to_pylist():
                bits |= unpacked(blob)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([pa.compress(bits.tobytes(), "lz4", asbytes=True)], pa.binary())], ["slice", "part", "bits"])

    schema = "slice int, part int, bits binary"
    parts = texts.mapInArrow(count, schema).groupBy("slice", "part").applyInArrow(join, schema).groupBy("slice").applyInArrow(join, schema)
    found = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for r in parts.collect():
        found[r["slice"]] = unpacked(r["bits"])
    return found.ravel()


def weight_levels(bitmaps: np.ndarray, n_docs: int) -> np.ndarray:
    """Each counter's inverse document frequency as a level from 1 to ``LEVELS``."""
    lowest = np.frexp((~bitmaps & (bitmaps + np.uint32(1))).astype(np.float64))[1] - 1  # of the bits that aren't set
    frequency = 2.0 ** np.where(bitmaps == np.uint32(0xFFFFFFFF), 32, lowest) / 0.77351
    n_docs, rare = max(n_docs, 1), max(n_docs / RARE, LEAST_RARE)
    idf = np.log1p(n_docs / np.maximum(frequency, rare)) / np.log1p(n_docs / rare)
    return np.clip(np.ceil(idf * LEVELS - 1e-9), 1, LEVELS).astype(np.uint8)


def profile(text: str, levels: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Key of the text's words, its distinct shingles, their counts and their weights' levels."""
    words = words_of(text)
    h, counts = np.unique(_shingler.hashes(words), return_counts=True)
    return xxhash.xxh3_128_digest(b" ".join(words)), h, counts, levels[_counters(h)]


def elements(h: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted set as a plain one: each shingle as often as it occurs, by number, with its level. What two texts
    share of these is the sum of the smaller weights."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.repeat(h, counts) + nth.astype(np.uint64) * BASE, np.repeat(levels, counts)


def links_of(sets: Sequence[tuple[np.ndarray, np.ndarray]], others: Sequence[tuple[np.ndarray, np.ndarray]] | None, threshold: float) -> np.ndarray:
    """Which pairs of ``sets`` (with ``others``, or with each other) have that weighted Jaccard similarity.

    The sums of common weights are a product of two matrices of sets by elements, some columns at a time. They are whole
    numbers, so nothing is rounded.
    """
    every = [*sets, *(others or ())]
    total = np.array([int(w.sum(dtype=np.int64)) for _, w in every], float)
    n = len(sets)
    if len(every) == 2:
        _, at, _ = np.intersect1d(every[0][0], every[1][0], assume_unique=True, return_indices=True)
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = every[0][1][at].sum(dtype=np.int64)
        common = common if others is None else common[:1, 1:]
    else:
        h, w = np.concatenate([x for x, _ in every]), np.concatenate([x for _, x in every])
        row = np.repeat(np.arange(len(every)), [len(x) for x, _ in every])
        order = np.argsort(h, kind="stable")
        h, w, row = h[order], w[order], row[order]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        some = shared[column]
        column, w, row = (np.cumsum(shared) - 1)[column[some]], w[some], row[some]
        common = np.zeros((n, n if others is None else len(others)))
        for first in range(0, int(shared.sum()), 8192):
            a, b = np.searchsorted(column, [first, first + 8192])
            x = np.zeros((len(every), 8192), np.float32)
            x[row[a:b], column[a:b] - first] = 1
            y = x.copy()
            y[row[a:b], column[a:b] - first] = w[a:b]
            common += x[:n] @ (y if others is None else y[n:]).T
    both = total[:n, None] + (total if others is None else total[n:])[None, :] - common
    return common >= threshold * both - 1e-9


class _Union:
    """Joins labels; yields a link for each join."""

    def __init__(self) -> None:
        self.parent: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _linked(rows: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Links (``a, b``) between the labels (``component``) of rows with equal ``by``, as few as join what is similar.

    ``rows`` also has ``side`` (rows of side 0 are compared with those of side 1, or with each other if there are none)
    and the set's ``h`` and ``w``. Rows of one group come to one task and are read as a stream; a group is two packs at
    most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        known = None

        def settled() -> Iterator[pa.RecordBatch]:
            sets = {s: [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.uint8)) for _, side, h, w in group if side == s] for s in (0, 1)}
            names = {s: [c for c, side, _, _ in group if side == s] for s in (0, 1)}
            if sets[0] and (sets[1] or len(sets[0]) > 1):
                similar = links_of(sets[0], sets[1] or None, threshold)
                union, found = _Union(), set()
                for i, j in zip(*(x.tolist() for x in np.nonzero(similar))):
                    a, b = names[0][i], names[1 if sets[1] else 0][j]
                    if a != b and union.join(a, b):
                        found.update((a, b))
                pairs = [(x, top) for x in found if (top := union.find(x)) != x]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*pairs)], ["a", "b"])

        for batch in _parts(batches):
            columns = [c.to_pylist() for c in batch.columns]
            for key, *row in zip(zip(*columns[: len(by)]), *columns[len(by) :]):
                if key != known:
                    yield from settled()
                    group, known = [], key
                group.append(tuple(row))
        yield from settled()

    return rows.select(*by, "component", "side", "h", "w").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary")


def _packs(n: Column) -> Column:
    """How many packs so many members make, a power of two."""
    return F.when(n <= PACK, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n / PACK)))).cast("long")


def _dealt(packs: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(salt)), packs)


def classes(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, class_id, first, n_same`` of every row: ``first`` marks the smallest (id, hash) of a class,
    on every row that equals it; ``n_same`` is how many rows do."""
    docs = id_and_text(df, id_col, text_col)
    levels = docs.sparkSession.sparkContext.broadcast(weight_levels(document_bitmaps(docs.select("text")), docs.count()))
    names = [f"b{k}" for k in range(BANDS)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in _parts(batches):
            keys, bands = [], np.zeros((len(batch), BANDS), np.int64)
            for k, text in enumerate(batch.column(2).to_pylist()):
                key, *shingles = profile(text, levels.value)
                keys.append(key)
                if len(shingles[0]):
                    bands[k] = sampler.bands(*shingles)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in bands.T)], ["doc_id", "text_hash", "key", *names])

    rows = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, "doc_id long, text_hash long, key binary, " + ", ".join(f"{n} long" for n in names)), "signed")
    labels = alone(df.sparkSession, lambda: _labels(docs, rows, members_of(rows, names), levels, threshold), "labels")
    named = rows.select("doc_id", "text_hash", "key").join(labels.withColumnRenamed("component", "label"), "key", "left").select("doc_id", "text_hash", F.coalesce("label", "key").alias("label"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    same = written(named.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("n_same")), "classes")
    first = written(same.groupBy("label").agg(F.min(order).alias("least")), "first")  # a table, so that the join can split large classes
    of = same.join(first, "label").select("doc_id", "text_hash", "n_same", F.col("least.doc_id").alias("class_id"), (order == F.col("least")).alias("first"))
    return of.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_same").cast("int")))).drop("copy")


def members_of(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``bucket, n, key``: the texts of each bucket that has several; of buckets with the same texts, one."""
    texts = rows.groupBy("key").agg(*(F.min(n).alias(n) for n in names))
    members = texts.select("key", F.explode(F.array(*names)).alias("bucket")).filter("bucket <> 0")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("n > 1")
    return written(members.join(shared.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "bucket"), "members")


def _sets(docs: DataFrame, rows: DataFrame, members: DataFrame, levels) -> DataFrame:
    """``key, h, w`` of the members: their elements and these elements' levels, as bytes."""
    wanted = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")).join(members.select("key").distinct(), "key", "left_semi")
    wanted = wanted.select(F.coalesce("x.doc_id", F.lit(0)).alias("i"), F.col("x.text_hash").alias("text_hash"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found = []
            for text in batch.column(0).to_pylist():
                key, *shingles = profile(text, levels.value)
                h, w = elements(*shingles)
                found.append((key, h.tobytes(), w.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["key", "h", "w"])

    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("text_hash"), "text").join(wanted, ["i", "text_hash"]).select("text")
    return written(texts.mapInArrow(shingled, "key binary, h binary, w binary").dropDuplicates(["key"]), "sets")


def _labels(docs: DataFrame, rows: DataFrame, members: DataFrame, levels, threshold: float) -> DataFrame:
    """``key, component`` of the texts that have links."""
    labels = docs.sparkSession.createDataFrame([], "key binary, component binary")
    if members.isEmpty():
        return labels
    sets = _sets(docs, rows, members, levels)

    def links(of: DataFrame, *by: str) -> DataFrame:
        return written(_linked(of.join(sets, "key"), by, threshold), "links")

    labels = relabelled(labels, links(members.select("bucket", _dealt(_packs(F.col("n"))).alias("pack"), "key", F.col("key").alias("component"), F.lit(0).alias("side")), "bucket", "pack"))
    large = members.filter(F.col("n") > PACK)
    if large.isEmpty():
        return labels

    def divided() -> DataFrame:
        """Members of large buckets with more than one class, with their classes and whether theirs is the largest."""
        now = large.select("bucket", "key").join(labels, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
        sizes = now.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        most = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("x"), F.sum("size").alias("n"), F.count("*").alias("classes")).filter("classes > 1")
        return written(now.join(most.select("bucket", "n", F.col("x.size").alias("size"), F.col("x.component").alias("largest")), "bucket"), "divided")

    salt, now = 0, divided()
    while True:
        salt += 1
        some = now.groupBy("bucket", "component", _dealt(F.lit(REPRESENTATIVES), salt)).agg(F.min("key").alias("key"))
        some = some.join(some.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        found = links(some.select("bucket", _dealt(_packs(F.col("n")), -salt).alias("pack"), "key", "component", F.lit(0).alias("side")), "bucket", "pack")
        if found.isEmpty():
            break
        labels = relabelled(labels, found)
        now = divided()
    return relabelled(labels, links(_opposed(now), "bucket", "one", "other"))


def _opposed(now: DataFrame) -> DataFrame:
    """Pack against pack: members outside their bucket's largest class on one side, all of the bucket on the other."""
    few, every = _packs(F.col("n") - F.col("size")), _packs(F.col("n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    one = now.filter("component <> largest").select("bucket", _dealt(few).alias("one"), upto(every).alias("other"), "key", "component", F.lit(0).alias("side"))
    other = now.select("bucket", upto(few).alias("one"), _dealt(every).alias("other"), "key", "component", F.lit(1).alias("side"))
    return one.unionByName(other)


def keep_one_of_each(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that come first in their class; of equal rows one.

    Rows are equal where id and text are; which of them stays where other columns differ is left open."""
    first = written(classes(df, threshold, id_col, text_col).filter("first").select("doc_id", "text_hash", "n_same").distinct(), "first")
    rows = df.select(F.struct(*map(_quoted, df.columns)).alias("row"), _quoted(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(_quoted(text_col), F.lit(""))).alias("hash"))
    on = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    alone = rows.join(first.filter("n_same = 1"), on, "left_semi").select("row.*")
    again = first.filter("n_same > 1")
    if again.isEmpty():
        return alone
    return alone.union(rows.join(again, on, "left_semi").dropDuplicates(["i", "hash"]).select("row.*"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("first").alias("kept"))
