"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one numpy array of symbols. Each round finds the lowest-ranked pair of every
sequence and merges all its occurrences at once, in all sequences together; sequences without a known pair leave. What
is left of each is its number of tokens. A pair's rank is above the ranks of the pairs that make its parts, so merging
all occurrences of one rank at once gives the same result as merging them one at a time.

Null texts are empty: 0 bytes and 0 tokens. Rows with equal or null ids each get a row. An empty table gives none.
Texts of any length are counted whole; a text costs memory in proportion to its own length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veridex.llm._common import id_and_text, table, tokenizer_path
from veridex.llm.encoders import byte_letters

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
IN_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Before a space, unless white space is on both of its sides: there no pre-token can go on.
CUT = re.compile(r"(?<!\s)(?= )|(?= (?!\s|\Z))")
#: Characters of a piece that is kept for the next texts; longer ones are counted each time.
LONG = 64
NO_PAIR = np.int32(2**31 - 1)


class MergeCounter:
    """Counts tokens for a byte-level BPE file of the tokenizers library, special strings included."""

    def __init__(self, path: str, limit: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)  # by byte
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: The pre-tokenizer's pattern is a fixed value of byte-level BPE files. [\x1c-\x1f] are no white space there.
        self.pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.limit = limit
        self.known: dict[str, int] = {}  # tokens of each short piece

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def merge(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merged together."""
        raw = [p.encode("utf-8", "replace") for p in pretokens]
        left = np.fromiter(map(len, raw), np.int64, len(raw))
        counts = np.maximum(left, 0)
        ids = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), left)
        ends = np.ones(len(ids), bool)  # whether the next symbol belongs to another sequence
        ends[:-1] = owner[1:] != owner[:-1]
        rank = np.full(len(ids), NO_PAIR, np.int32)
        inner = np.flatnonzero(~ends)
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, ends[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.r_[starts, len(ids)])
            done = lowest == NO_PAIR
            if done.any():
                counts[owner[starts[done]]] = length[done]
                stay = np.repeat(~done, length)
                ids, owner, ends, rank = ids[stay], owner[stay], ends[stay], rank[stay]
                lowest, length = lowest[~done], length[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(lowest, length)
            at = np.flatnonzero(hit)
            # in a run such as aaa the pairs overlap: every second one counts, from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            ids[at] = self.merged[rank[at]]
            ends[at] = ends[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where the merged symbols stand afterwards
            ids, owner, ends, rank = ids[keep], owner[keep], ends[keep], rank[keep]
            for touched in (new, new[new > 0] - 1):
                open_ = touched[~ends[touched]]
                rank[touched] = NO_PAIR
                rank[open_] = self._rank(ids[open_], ids[open_ + 1])
        return counts

    def _counts(self, pieces: list[str]) -> list[int]:
        """Tokens of distinct pieces."""
        split: list[list[str]] = []
        special = [0] * len(pieces)
        for k, piece in enumerate(pieces):
            if self.at_special and any(s in piece for s in self.special):
                special[k] = len(self.at_special.findall(piece))
                split.append([w for part in self.at_special.split(piece) for w in self.pre.findall(part)])
            else:
                split.append(self.pre.findall(piece))
        distinct = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        counts = self.merge(list(distinct)).tolist() if distinct else []
        return [extra + sum(counts[distinct[w]] for w in ws) for ws, extra in zip(split, special)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text. A text is cut before its spaces, where pre-tokens never join unless white space is
        on both sides."""
        found: list[int] = []
        group: list[list[str]] = []
        size = 0
        for k, t in enumerate(texts):
            if IN_SPACE.search(t):
                group.append([p for p in CUT.split(t) if p])
            else:
                head, *rest = t.split(" ")
                group.append([head, *(" " + p for p in rest)] if rest else [head])
            size += len(t)
            if size > 2_000_000 or k == len(texts) - 1:
                found += self._group(group)
                group, size = [], 0
        return found

    def _group(self, group: list[list[str]]) -> list[int]:
        used = set().union(*group)
        if len(self.known) > self.limit:
            self.known = {p: self.known[p] for p in used & self.known.keys()}
        new = [p for p in used if p not in self.known]
        counts = dict(zip(new, self._counts(new)))
        self.known.update((p, n) for p, n in counts.items() if len(p) <= LONG)
        get = (self.known | {p: n for p, n in counts.items() if len(p) > LONG}).__getitem__ if any(len(p) > LONG for p in new) else self.known.__getitem__
        return [sum(map(get, p)) for p in group]


_counters: dict[str, MergeCounter] = {}


def token_counts(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``max_tokens``) of every row. A narrow stage, no shuffle.

    ``tokenizer``: path or public name of a byte-level BPE ``.json``; its special strings inside texts count as the
    library counts them by default (one token each).
    """
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = MergeCounter(path)
        counter = _counters[path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
