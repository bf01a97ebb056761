"""Quality by repetition coverage: how many of a text's characters lie in duplicated n-grams and duplicated lines.

Words are runs of anything but ASCII white space. Rolling hashes of several n-gram lengths are made in numpy from 64-bit
word values, a length at a time (h_n = h_(n-1) * base + value of the n-th word), so every length costs one pass. A
window that repeats has shorter windows that repeat, so longer lengths are looked up only where the shortest repeats.
Each verdict is a share of the text's own word characters; a text of any length is measured whole.

Null texts are empty: no words, hence they fail the base rule. Rows with equal or null ids are judged one by one, and
rows with equal texts get equal verdicts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veridex.llm._common import id_and_text, table

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double"

#: Largest share of characters in repeats of n words (the first occurrence not counted), by n.
MOST_IN_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Fixed value: largest share of characters in lines that equal an earlier line.
MOST_IN_LINES = 0.3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_values(n: int) -> np.ndarray:
    """A 64-bit value for each of n distinct words of a text, well mixed (splitmix64 of the word's number)."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _repeats(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows ``at``: those that occur at least twice, and of these all but each one's first."""
    h = hashes[at]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:]] = same
    both = again.copy()
    both[order[:-1]] |= same
    return at[both], at[again]


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measured(text: str, most_in_ngrams: dict[int, float] = MOST_IN_NGRAMS, most_in_lines: float = MOST_IN_LINES) -> tuple:
    """One row of ``SCHEMA`` without the id."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(line.translate(None, SPACES).decode("utf-8"))
        elif line and not line.isspace():
            seen.add(line)
    n_repeat_words, worst, excess = 0, 0.0, False
    if n_words >= 5:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
        value = _word_values(len(number))[ids]
        with np.errstate(over="ignore"):
            h = value[: n_words - 4].copy()
            for k in range(1, 5):
                h = h * BASE + value[k : n_words - 4 + k]
        both, again = _repeats(h, np.arange(n_words - 4))
        if len(both):
            n_repeat_words = int(_covered(both, 5, n_words).sum())
            chars = np.fromiter((len(w.decode("utf-8")) for w in words), np.int64, n_words)
            for n in sorted(most_in_ngrams):
                if n > 5:
                    both = both[both <= n_words - n]
                    with np.errstate(over="ignore"):
                        h = h[: max(0, n_words - n + 1)] * BASE + value[n - 1 :]
                    both, again = _repeats(h, both)
                if not len(again):
                    break
                share = float(chars[_covered(again, n, n_words)].sum()) / word_chars
                worst = max(worst, share)
                excess |= share > most_in_ngrams[n]
    line_share = dup_line_chars / word_chars if word_chars else 0.0
    base_failed = n_words < 10 or 100 * n_repeat_words > 20 * n_words
    kept = not (base_failed or excess or line_share > most_in_lines)
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, worst, line_share


def repetition_quality(df: DataFrame, most_in_ngrams: dict[int, float] | None = None, most_in_lines: float = MOST_IN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCHEMA`` of every row; a narrow stage without shuffle.

    ``most_in_ngrams``: consecutive n from 5 on with the largest share of characters in repeated windows of n words.
    """
    limits = most_in_ngrams or MOST_IN_NGRAMS
    if sorted(limits) != list(range(5, 5 + len(limits))):
        raise ValueError("n-gram lengths must be consecutive and begin at 5")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [measured(t, limits, most_in_lines) for t in batch.column(1).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_unrepetitive(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that the rule keeps."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measured(t or "")[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op4_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(table(spark, sf_dir, "documents"))
