"""Token ids in Re-Pair compressed shard files with random access.

Documents are range-partitioned and sorted by id, encoded, and cut into shards of a bounded number of ids (whole
documents). In each shard frequent pairs of neighbouring symbols are replaced by nonterminals, the most frequent first,
until no pair occurs ``least`` times: a rule that is used less often would cost more than it saves. No rule crosses a
document's end, so each document is a range of the compressed symbols.

Shard file (little-endian; written as one binary value per shard in a Parquet table of the shared folder):
``RPG1`` | uint32 symbols below the first nonterminal, rules, documents, compressed symbols | rules as two uint32 |
their expansion lengths as uint32 | documents' compressed ends as uint64 | documents' expanded ends as uint64 |
documents' ids as int64 and a byte each that is 1 for a null id | the symbols' low 16 bits as uint16, then a bit of each
symbol for every higher bit of the largest number.

Null texts are empty: the end id alone. Null ids come first; rows with equal ids keep one place each, in the order of
their texts' hashes. An empty table gives no shard. A document longer than a shard gets a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import id_and_text, table, tokenizer_path, written
from veridex.llm.encoders import encoder
from veridex.llm.packing import offsets_of

MAGIC = b"RPG1"
SHARDS = "part int, shard int, before long, n long, file binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys occur at least ``least`` times, the place of each among these, the most frequent first, and these."""
    bits = min(max(len(keys).bit_length() - 1, 8), 20)  # slots of a sieve, and of a table of the frequent ones
    with np.errstate(over="ignore"):
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    often = np.bincount(slots, minlength=1 << bits) >= least  # a slot's count is at least its keys'
    maybe = np.flatnonzero(often[slots])
    keys, slots = keys[maybe], slots[maybe]
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    counts = np.diff(np.r_[starts, len(ordered)])
    found, counts = ordered[starts[counts >= least]], counts[counts >= least]
    by_count = np.argsort(-counts, kind="stable")
    if not len(found):
        return maybe[:0], maybe[:0], found
    place = np.empty(len(found), np.int64)
    place[by_count] = np.arange(len(found))
    with np.errstate(over="ignore"):
        own = (found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[own] = np.arange(len(found), dtype=np.int32)
    at = table[slots]
    hit = found[at] == keys
    if len(lost := np.flatnonzero(table[own] != np.arange(len(found)))):  # another frequent pair has their slot
        some = np.zeros(1 << bits, bool)
        some[own[lost]] = True
        rest = np.flatnonzero(some[slots])
        at[rest] = np.minimum(np.searchsorted(found, keys[rest]), len(found) - 1)
        hit[rest] = found[at[rest]] == keys[rest]
    hit = np.flatnonzero(hit)
    return maybe[hit], place[at[hit]], found[by_count]


def compress(ids: np.ndarray, end_id: int, base: int, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) of a stream in which ``end_id`` is part of no rule.

    A round takes the pairs that occur at least ``least`` times, the more frequent first, and each one's occurrences
    that no pair before it has taken; a pair whose free occurrences are fewer waits for a later round. Only places whose
    pair is frequent or has a new symbol are looked at again: counts of other pairs can but fall. The last round looks
    at every place and finds no pair left, so the result is closed: no pair without ``end_id`` occurs ``least`` times
    (of overlapping occurrences, as in ``aaa``, every second one counts).
    """
    symbol = ids.astype(np.int32)
    rules: list[int] = []
    known: dict[int, int] = {}  # nonterminals by pair
    size, again, every = base, False, True
    live = np.arange(max(len(symbol) - 1, 0))  # places to look at, by their pair's left symbol
    while True:
        a, b = symbol[live], symbol[live + 1]
        use = (a != end_id) & (b != end_id)
        same = np.flatnonzero(use & (a == b))
        place = live[same]
        run = np.flatnonzero(np.r_[True, np.diff(place) != 1][: len(place)])
        odd = (np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))) % 2 == 1
        use[same[odd]] = False  # in a run of one symbol every second place counts
        odd = place[odd]
        at = live[use]
        yes, of, pairs = _frequent(a[use].astype(np.int64) << 32 | b[use], least)
        if not len(pairs):
            if every or not again:
                break
            again, every, live = False, True, np.arange(len(symbol) - 1)
            continue
        none = len(pairs)
        at = at[yes]
        rank = np.full(len(symbol) + 1, none, np.int32)  # the place's pair; -1 is the last entry, beyond all places
        rank[at] = of
        free, taken = at, []
        while len(free):  # those before both neighbours are taken, and their neighbours go
            own = rank[free]
            first = (own < rank[free - 1]) & (own < rank[free + 1])
            best = free[first]
            taken.append(best)
            rank[best - 1] = rank[best + 1] = none
            free = free[~first]
            free = free[rank[free] < none]
        taken = np.sort(np.concatenate(taken))
        of = rank[taken]
        enough = np.bincount(of, minlength=none) >= least
        chosen = enough[of]
        taken, of = taken[chosen], of[chosen]
        number = np.zeros(none, np.int32)
        for k in np.flatnonzero(enough).tolist():
            pair = int(pairs[k])
            if pair in known:  # it waited in part: its neighbours' counts may rise
                again = True
            else:
                known[pair] = size
                rules.append(pair)
                size += 1
            number[k] = known[pair]
        symbol[taken] = number[of]
        stay = np.ones(len(symbol), bool)
        stay[taken + 1] = False
        look = np.zeros(len(symbol) + 1, bool)
        look[at] = look[odd] = look[taken] = True
        look[taken[taken > 0] - 1] = True
        # a symbol before a taken place may itself go: then the place before it, a taken one, is looked at anyway
        symbol, look = symbol[stay], look[:-1][stay]
        live = np.flatnonzero(look[:-1])
        every = False
    rules = np.array(rules, np.int64)
    return symbol.astype(np.uint32), np.stack([rules >> 32, rules & 0xFFFFFFFF], 1).astype(np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append(sum(lengths[s - base] if s >= base else 1 for s in (a, b)))
    return np.array(lengths, np.int64)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol where its expansion begins in a flat array, its length, and that array."""
    parts: list[np.ndarray] = []
    for a, b in rules.tolist():
        parts.append(np.concatenate([parts[s - base] if s >= base else np.array([s], np.uint32) for s in (a, b)]))
    lengths = np.concatenate([np.ones(base, np.int64), np.fromiter(map(len, parts), np.int64, len(parts))])
    flat = np.concatenate([np.arange(base, dtype=np.uint32), *parts])
    return np.cumsum(lengths) - lengths, lengths, flat


def symbol_bytes(symbols: np.ndarray, most: int) -> bytes:
    """The low 16 bits of all symbols, then each higher bit that ``most`` has, eight symbols a byte."""
    planes = [np.packbits((symbols >> bit & 1).astype(np.uint8)).tobytes() for bit in range(16, max(16, int(most).bit_length()))]
    return b"".join([symbols.astype("<u2").tobytes(), *planes])


def write_shard(doc_ids: list[int | None], blobs: list[bytes], end_id: int, base: int) -> bytes:
    ids = np.frombuffer(b"".join(blobs), "<u4")
    ends = np.cumsum(np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs)))
    stream, rules = compress(ids, end_id, base)
    lengths = np.concatenate([np.ones(base, np.int64), rule_lengths(rules, base)])
    packed_ends = np.searchsorted(np.cumsum(lengths[stream]), ends, side="left") + 1
    head = MAGIC + struct.pack("<4I", base, len(rules), len(blobs), len(stream))
    return b"".join([
        head, rules.astype("<u4").tobytes(), lengths[base:].astype("<u4").tobytes(), packed_ends.astype("<u8").tobytes(), ends.astype("<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), symbol_bytes(stream, base + len(rules)),
    ])


class ShardReader:
    """Documents of a shard file, all or single ones."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a shard file")
        self.base, n_rules, n_docs, n_symbols = struct.unpack_from("<4I", file, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(file, kind, n, at)
            at += found.nbytes
            return found

        self.rules, self.rule_lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.packed_ends, self.ends = take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.symbols = take("<u2", n_symbols).astype(np.uint32)
        for bit in range(16, max(16, (self.base + n_rules).bit_length())):
            self.symbols |= np.unpackbits(take("u1", (n_symbols + 7) // 8), count=n_symbols).astype(np.uint32) << bit
        self.at, self.length, self.flat = expansions(self.rules, self.base)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.length[symbols]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.at[symbols] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; only its own symbols are expanded."""
        return self.expand(self.symbols[self.packed_ends[k - 1] if k else 0 : self.packed_ends[k]])


def shards(df: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shard files; a table of ``SHARDS``. ``shard_ids`` bounds a shard's ids, but for a single document's."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part = encoder(path), TaskContext.get().partitionId()
        base = max(library.size, end_id + 1)
        end, before, shard = np.array([end_id], "<u4").tobytes(), 0, 0
        docs: list[int | None] = []
        blobs: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            file = write_shard(docs, blobs, end_id, base)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([file], pa.binary())], ["part", "shard", "before", "n", "file"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), library.encode(batch.column(1).to_pylist())):
                x += end
                if blobs and size + len(x) // 4 > shard_ids:
                    yield flush()
                    before, shard, docs, blobs, size = before + size, shard + 1, [], [], 0
                docs.append(d)
                blobs.append(x)
                size += len(x) // 4
        if blobs:
            yield flush()

    docs = id_and_text(df, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(docs.mapInArrow(run, SHARDS), "shards")


def read_documents(files: DataFrame) -> DataFrame:
    """``READ`` of every document, decoded from the shard files."""
    offsets = offsets_of(files.select("part", "before", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, before, _, file in zip(*(c.to_pylist() if k < 4 else c for k, c in enumerate(batch.columns))):
                reader = ShardReader(memoryview(file.as_buffer()))
                ids = reader.expand(reader.symbols).astype("<u4").tobytes()
                starts = np.r_[0, reader.ends[:-1]]
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), reader.ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64()), pa.array(starts + offsets[part] + before), pa.array(reader.ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, READ)


def op8_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(shards(table(spark, sf_dir, "documents")))
