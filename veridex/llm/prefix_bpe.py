"""Byte-level BPE by prefix dynamic programming, with exact appends and edits.

The encoding of every byte prefix of a pre-token has one last token, and the encoding of the prefix before that token
is the rest. So a table of last tokens, one for each prefix, holds the encodings of all prefixes at once: the next entry
is the one token that ends there and stays apart from the last token of what is before it. An automaton over all tokens
names those that end at a place. Whether two tokens stay apart follows from the merges at their common border alone.

An append lengthens the table. An edit keeps the entries before it, and those after it from where as many entries as the
longest token has bytes are again what they were, for an entry depends on no others.

Texts are split by a pattern first, each match encoded by itself. The pattern must cover any text, must not look behind,
and must not look further than ``AHEAD`` characters beyond a match (``public_tokenizers.PATTERN`` does so): a text may then
be split anew from the end of any match, and a match that ends ``AHEAD`` before an end is the same whatever follows.

A null text is empty and has no ids; a null array of ids gives empty bytes. Rows with equal or null ids each get a row;
an empty table gives none. Texts of any length are encoded whole, in parts of ``PART`` characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import id_and_text, table, tokenizer_path

AHEAD = 2
PART = 1 << 20
#: Characters of a pre-token whose ids are kept for the next texts, how many of these are kept, and how many answers
#: about pairs of tokens.
LONG, KNOWN, PAIRS = 64, 300_000, 1_000_000
#: Bytes of text whose ids go to Spark in one batch, and ids that are decoded together.
BATCH, DECODED = 8 << 20, 1 << 18


@dataclass(frozen=True)
class Table:
    """A text, where its pre-tokens end (in characters), and of each its prefixes' last tokens."""

    text: str
    ends: list[int]
    last: list[list[int]]


class PrefixEncoder:
    """A vocabulary of ranks (``.tiktoken``): each line has a token in base64 and its rank, which is its id."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # \s of the module also takes \x1c to \x1f, which are no white space in Unicode
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        #: The two tokens that make each token; -1 for single bytes.
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.pairs: dict[int, int] = {}
        self.known_pairs: dict[int, bool] = {}
        self.ends_here = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes[rank] = token
            self.ends_here.add_word(token.decode("latin-1"), rank)
            if len(token) > 1:
                self._learn(token, rank, ranks)
        self.ends_here.make_automaton()
        self.length = list(map(len, self.bytes))
        self.longest = max(self.length)
        self.flat, self.sizes = np.frombuffer(b"".join(self.bytes), np.uint8), np.array(self.length)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known_pairs.clear()
        self.known = _Known(self)

    def _learn(self, token: bytes, rank: int, ranks: dict[bytes, int]) -> None:
        """The merge that makes a token is the one cut whose sides stay apart until then."""
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
            if a < rank and b < rank and self.apart(a, b):
                self.left[rank], self.right[rank] = a, b
                self.pairs[a * self.size + b] = rank
                return
        raise ValueError(f"no merge gives {token!r}")

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, put together, are encoded as just these two.

        Back from the two tokens, the later merge is undone first. While two symbols face each other, their own merge
        would come before the merge that takes the left one away, and not after that which takes the right one (of equal
        merges the left comes first)."""
        until_a = until_b = self.size
        while True:
            merged = self.pairs.get(a * self.size + b)
            if merged is not None and merged < until_a and merged <= until_b:
                return False
            if self.right[a] >= 0 and (a > b or self.left[b] < 0):
                until_a, a = a, self.right[a]
            elif self.left[b] >= 0:
                until_b, b = b, self.left[b]
            else:
                return True

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Lengthens ``last``, the last tokens of the first prefixes of ``data``, to ``stop`` prefixes (or all)."""
        stop = len(data) if stop is None else stop
        size, length, known, n = self.size, self.length, self.known_pairs, len(last)
        for end, token in self.ends_here.iter(data[:stop].decode("latin-1"), max(0, n + 1 - self.longest)):
            if end == n:
                before = end - length[token]
                if before >= 0:
                    key = last[before] * size + token
                    if (follows := known.get(key)) is None:
                        follows = known[key] = self.apart(last[before], token)
                    if not follows:
                        continue
                last.append(token)
                n += 1
        if len(known) > PAIRS:
            known.clear()

    def walk(self, last: list[int]) -> list[int]:
        """The ids of the whole pre-token that a table belongs to."""
        ids, at = [], len(last) - 1
        while at >= 0:
            ids.append(last[at])
            at -= self.length[last[at]]
        return ids[::-1]

    def parts(self, text: str, size: int = PART) -> Iterator[list[str]]:
        """The pre-tokens of a text, a part of it at a time."""
        at = 0
        while at < len(text):
            part = text[at : at + size]
            found, end = self.split(part), len(part)
            if at + size < len(text):
                while found and end > len(part) - AHEAD:
                    end -= len(found.pop())
            if not found:
                size *= 2  # one pre-token is longer than the part
                continue
            yield found
            at += end

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        of = self.known.__getitem__
        return b"".join(b"".join(map(of, part)) for part in self.parts(text))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after the other; ValueError for an id that isn't in the vocabulary."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.sizes[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        out = []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            n = self.sizes[part]
            after = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[part] - after + n, n) + np.arange(after[-1])].tobytes())
        return b"".join(out)

    def table(self, text: str) -> Table:
        return self.replaced(Table("", [], []), 0, 0, text)

    def ids(self, of: Table) -> list[int]:
        return [i for last in of.last for i in self.walk(last)]

    def appended(self, of: Table, more: str) -> Table:
        return self.replaced(of, len(of.text), len(of.text), more)

    def replaced(self, of: Table, start: int, stop: int, new: str) -> Table:
        """The table of the text whose characters from ``start`` to ``stop`` are now ``new``; what they can't have changed
        is taken over."""
        start = min(max(start, 0), len(of.text))
        stop = min(max(stop, start), len(of.text))
        text = of.text[:start] + new + of.text[stop:]
        keep = int(np.searchsorted(of.ends, start - AHEAD, side="right"))
        at, shift = (of.ends[keep - 1] if keep else 0), len(new) - (stop - start)
        old = {end + shift: k + 1 for k, end in enumerate(of.ends) if end >= stop}
        ends, last, source = of.ends[:keep], of.last[:keep], keep
        for part in self.parts(text[at:]):
            for piece in part:
                before = self._old_piece(of, source, at)
                last.append(self._table(piece.encode(), *before))
                at += len(piece)
                ends.append(at)
                source += 1
                if at in old and at >= start + len(new):
                    k = old[at]
                    return Table(text, ends + [e + shift for e in of.ends[k:]], last + of.last[k:])
        return Table(text, ends, last)

    @staticmethod
    def _old_piece(of: Table, k: int, at: int) -> tuple[bytes, list[int]]:
        """The pre-token that stood in the same place, if it began there."""
        if k < len(of.ends) and (of.ends[k - 1] if k else 0) == at:
            return of.text[at : of.ends[k]].encode(), of.last[k]
        return b"", []

    def _table(self, data: bytes, was: bytes, table: list[int]) -> list[int]:
        """The table of ``data`` from that of ``was``: equal bytes before and after the place where they differ count again."""
        most = min(len(data), len(was))
        a, b = np.frombuffer(data, np.uint8), np.frombuffer(was, np.uint8)
        differ = np.flatnonzero(a[:most] != b[:most])
        same = int(differ[0]) if len(differ) else most
        last = table[:same]
        differ = np.flatnonzero(a[len(a) - most + same :] != b[len(b) - most + same :])
        tail = most - same - (int(differ[-1]) + 1 if len(differ) else 0)  # equal bytes at the end
        shift = len(was) - len(data)
        if tail <= self.longest:
            self.extend(data, last)
            return last
        self.extend(data, last, len(data) - tail)
        while len(last) < len(data):
            self.extend(data, last, min(len(data), len(last) + self.longest))
            if len(last) - self.longest >= len(data) - tail and last[-self.longest :] == table[len(last) + shift - self.longest : len(last) + shift]:
                return last + table[len(last) + shift :]
        return last


class _Known(dict):
    """Ids of pre-tokens met before; those of other ones are found when asked for. Once it is full, what isn't met again
    before it is full the next time is forgotten."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.before.get(piece)) is None:
            last: list[int] = []
            self.encoder.extend(piece.encode(), last)
            ids = pack(f"<{len(ids := self.encoder.walk(last))}i", *ids)
        if len(piece) <= LONG:
            if len(self) >= KNOWN:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_encoders: dict[tuple[str, str], PrefixEncoder] = {}


def prefix_encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> PrefixEncoder:
    """The worker's own encoder of a file; it lives as long as the worker does."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = PrefixEncoder(path, pattern)
    return _encoders[path, pattern]


def _lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encoded(df: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row. A narrow stage; a batch that goes back to Spark has ``BATCH`` bytes of text, or one text."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = prefix_encoder(path, pattern).encode
        for batch in batches:
            keys, texts = batch.columns
            begin, size, found = 0, 0, []
            for k in range(len(texts)):
                text = texts[k].as_py()
                found.append(encode(text))
                size += len(text)
                if size >= BATCH or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, k + 1 - begin), _lists(found)], ["doc_id", "ids"])
                    begin, size, found = k + 1, 0, []

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(df: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded`` (binary) of every row; an id that the vocabulary doesn't have is an error."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = prefix_encoder(path)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            data = pa.py_buffer(own.decode(ids))
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(own.sizes[ids])])
            ends = ends[np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])]
            texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


TABLES = "doc_id long, text string, ends array<int>, last array<array<int>>, ids array<int>"


def tables(df: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``TABLES`` of every row: what ``edited`` goes on from."""
    return edited(id_and_text(df, id_col, text_col).select("doc_id", F.lit("").alias("text"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<array<int>>").alias("last"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.col("text").alias("new")), tokenizer)


def edited(df: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``TABLES`` after one edit of each row: the characters from ``start`` to ``stop`` become ``new`` (null: nothing). Places
    beyond the text are its end, so an append has a ``start`` as large as one likes."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = prefix_encoder(path)
        for batch in batches:
            for row in batch.to_pylist():
                of = own.replaced(Table(row["text"], row["ends"], row["last"]), row["start"], row["stop"], row["new"] or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]], pa.int64()), pa.array([of.text]), pa.array([of.ends], pa.list_(pa.int32())), pa.array([of.last], pa.list_(pa.list_(pa.int32()))), pa.array([own.ids(of)], pa.list_(pa.int32()))],
                    ["doc_id", "text", "ends", "last", "ids"],
                )

    return df.select("doc_id", "text", "ends", "last", F.col("start").cast("long"), F.col("stop").cast("long"), "new").mapInArrow(run, TABLES)


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decoded(encoded(table(spark, sf_dir, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
