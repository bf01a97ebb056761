"""Periodic runs of words by partition refinement.

At level p two places of a text are in one class if the p words from there on are equal. Level p + 1 follows from level p:
places stay together if the places after them are together, too. Only what has just split matters for that, and of the
parts of a class all but the largest (of which the others say enough); so a place is looked at a logarithmic number
of times, whatever the number of levels. A class is a stretch of one array, its members' order by place a linked list. A
member whose next one in the list is exactly p places on begins a square of period p, and p is its smallest period, else
a nearer member would stand between. Squares of one period side by side are one run.

All texts of a batch are refined together, in numpy: their words have numbers of their own, and an end mark of its own
after each text splits off what would reach beyond it. Places whose distance to the next member is wanted at a later level
are found by one scan for each doubling of the level; what gets such a distance between the scans is kept by its distance.
At most levels of a long text only a few places split off: these are taken one by one, without numpy's cost for each step.

A null text has no words and no runs. Rows with equal or null ids each get a row; an empty table gives none. A text of any
length is taken whole; memory follows the longest text, or ``BATCH`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm._common import table

#: Words that are refined together.
BATCH = 600_000
#: Places at a level up to which they are taken one by one.
FEW = 40
RUN = "struct<start: long, length: long, period: long>"


class Refinement:
    """Classes of equal factors of several sequences of codes, level by level.

    ``codes`` are of all sequences one after the other, each with an end mark that occurs nowhere else."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.level = 1
        _, self.of, self.size = np.unique(codes, return_inverse=True, return_counts=True)
        self.order = np.argsort(self.of, kind="stable")
        self.start = np.cumsum(self.size) - self.size
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        self._link(self.order, self.of[self.order])
        self.classes = len(self.size)
        #: Members of classes that have just split off, and places whose distance has just grown: lists where they are few.
        self.fresh: np.ndarray | list[int] = np.arange(n)
        self.wide: np.ndarray | list[int] = []
        self._views()

    def _views(self) -> None:
        """The arrays for access one by one, which is faster without numpy."""
        self.views = tuple(map(memoryview, (self.of, self.size, self.start, self.order, self.place, self.next, self.before)))

    def _link(self, places: np.ndarray, groups: np.ndarray) -> None:
        """The order within each group of places, sorted by group and place."""
        self.next[places], self.before[places] = -1, -1
        together = groups[1:] == groups[:-1]
        a, b = places[:-1][together], places[1:][together]
        self.next[a], self.before[b] = b, a

    def _room(self, more: int) -> None:
        if self.classes + more > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros(max(more, len(x)), np.int64)]) for x in (self.size, self.start))
            self._views()

    def advance(self) -> None:
        """One level further."""
        self.level += 1
        self.wide = []
        if len(self.fresh) <= FEW:
            self._few(self.fresh if isinstance(self.fresh, list) else self.fresh.tolist())
        else:
            self._many(np.asarray(self.fresh))

    def _few(self, fresh: list[int]) -> None:
        self._room(len(fresh))
        of, size, start, order, place, following, before = self.views
        families: dict[int, dict[int, list[int]]] = {}
        for k in sorted(fresh):
            if k and size[c := of[k - 1]] > 1:
                families.setdefault(c, {}).setdefault(of[k], []).append(k - 1)
        self.fresh = []
        for c, groups in families.items():
            leaving = sorted(groups.values(), key=len)
            rest = size[c] - sum(map(len, leaving))
            small = leaving
            if rest == 0:
                small = leaving = leaving[:-1]  # the largest stays
            elif rest < len(leaving[-1]):
                small = leaving[:-1]
            for group in leaving:
                for k in group:
                    left, right = before[k], following[k]
                    if left >= 0:
                        following[left] = right
                    if right >= 0:
                        before[right] = left
                        if left >= 0:
                            self.wide.append(left)
                    size[c] -= 1
                    last = start[c] + size[c]
                    other, at = order[last], place[k]
                    order[at], place[other] = other, at
                    order[last], place[k] = k, last
                    of[k] = self.classes
                    before[k] = following[k] = -1
                start[self.classes], size[self.classes] = last, len(group)
                self.classes += 1
                for a, b in zip(group, group[1:]):
                    following[a], before[b] = b, a
                self.wide += group[:-1]
            for group in small:
                self.fresh += group
            if small is not leaving:
                self.fresh += order[start[c] : start[c] + size[c]].tolist()

    def _many(self, fresh: np.ndarray) -> None:
        move = fresh[fresh > 0] - 1
        move = move[self.size[self.of[move]] > 1]
        if not len(move):
            self.fresh = []
            return
        old, by = self.of[move], self.of[move + 1]
        at = np.lexsort((move, by, old))
        move, old, by = move[at], old[at], by[at]
        first = np.r_[True, (old[1:] != old[:-1]) | (by[1:] != by[:-1])]  # of a group: those that go from one class by one splitter
        group = np.cumsum(first) - 1
        began = np.flatnonzero(first)
        count, parent = np.diff(np.r_[began, len(move)]), old[began]
        head = np.r_[True, parent[1:] != parent[:-1]]  # the first group of each parent
        family = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        rest = self.size[parent[heads]] - np.add.reduceat(count, heads)
        # the largest group of each parent: it stays where nothing else does
        largest = np.lexsort((count, family))[np.r_[heads[1:], len(parent)] - 1]
        stays = np.zeros(len(count), bool)
        stays[largest[rest == 0]] = True
        small = ~stays
        beaten = (rest > 0) & (rest < count[largest])  # the rest of the parent is smaller than a group
        small[largest[beaten]] = False
        smaller_rest = parent[heads[beaten]]
        goes = ~stays[group]
        move, old, group = move[goes], old[goes], group[goes]
        if not len(move):
            self.fresh = []
            return
        self._unlink(move)
        name = np.cumsum(~stays) - 1 + self.classes
        new = int((~stays).sum())
        self._room(new)
        self._to_the_end(move, old)
        names, counts = name[~stays], count[~stays]
        self.of[move] = name[group]
        self.size[names] = counts
        kept = np.bincount(family[~stays], counts, len(heads)).astype(np.int64)  # how many leave each parent
        self.size[parent[heads]] -= kept
        ends = self.start[parent[heads]] + self.size[parent[heads]]
        inside = np.cumsum(counts) - counts
        began = np.flatnonzero(np.r_[True, parent[~stays][1:] != parent[~stays][:-1]])
        inside -= np.repeat(inside[began], np.diff(np.r_[began, len(counts)]))
        self.start[names] = ends[family[~stays]] + inside
        self.classes += new
        self._link(move, name[group])
        fresh = [move[small[group]]]
        if len(smaller_rest):
            n = self.size[smaller_rest]
            fresh.append(self.order[np.repeat(self.start[smaller_rest] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        self.fresh = np.concatenate(fresh)
        self.wide = np.concatenate([self.wide, move[self.next[move] >= 0]])

    def _unlink(self, move: np.ndarray) -> None:
        """Takes places out of their lists."""
        at = np.lexsort((move, self.of[move]))
        move = move[at]
        inner = self.next[move[:-1]] == move[1:]  # followed by one that goes, too
        left, right = self.before[move[np.r_[True, ~inner]]], self.next[move[np.r_[~inner, True]]]
        self.next[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        self.wide = left[(left >= 0) & (right >= 0)]

    def _to_the_end(self, move: np.ndarray, old: np.ndarray) -> None:
        """Puts places, sorted by class and then by group, at the end of their classes' stretches, in this order."""
        began = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        n = np.diff(np.r_[began, len(old)])
        slots = np.repeat(self.start[old[began]] + self.size[old[began]] - n - began, n) + np.arange(len(old))
        sitting = self.order[slots]
        mark = self.place[move]
        self.place[move] = -1
        leaving = self.place[sitting] >= 0  # those in the way
        first = np.repeat(slots[began], n)
        holes = np.sort(mark[mark < first])  # stretches don't overlap: sorted by place they are sorted by stretch
        stay = sitting[leaving]
        stay = stay[np.argsort(self.place[stay], kind="stable")]
        self.order[holes], self.place[stay] = stay, holes
        self.order[slots], self.place[move] = move, slots


def squares(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each period up to ``most`` that has any, the places where a square begins whose smallest period it is."""
    r = Refinement(codes)
    until, at, cuts, late = 1, np.empty(0, np.int64), [0, 0], {}
    while r.level <= most:
        p = r.level
        if p == until:
            until, late = 2 * p, {}
            places = np.flatnonzero(r.next >= 0)
            if not len(places):
                return
            gap = r.next[places] - places
            soon = (gap >= p) & (gap < until)
            places, gap = places[soon], gap[soon]
            by = np.argsort(gap, kind="stable")
            at, cuts = places[by], np.searchsorted(gap[by], np.arange(p, until + 1)).tolist()
        a, b = cuts[p - until // 2], cuts[p - until // 2 + 1]
        if a < b or p in late:
            found = np.unique(np.concatenate([at[a:b], *late.pop(p, [])]))
            found = found[r.next[found] - found == p]
            if len(found):
                yield p, found
        r.advance()
        if isinstance(r.wide, list):
            following = r.views[5]
            for k in r.wide:
                if r.level <= (gap := following[k] - k) < until:
                    late.setdefault(gap, []).append([k])
            continue
        gap = r.next[r.wide] - r.wide
        soon = (gap >= r.level) & (gap < until)
        if soon.any():
            wide, gap = r.wide[soon], gap[soon]
            by = np.argsort(gap, kind="stable")
            wide, gap = wide[by], gap[by]
            firsts = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]]).tolist()
            for a, b in zip(firsts, [*firsts[1:], len(gap)]):
                late.setdefault(int(gap[a]), []).append(wide[a:b])


def runs(codes: np.ndarray, ends: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of the runs, by text, start and period. ``ends``: where each text's codes end; codes of
    different words of one text differ, and so do those of equal words of different texts."""
    sizes = np.diff(np.r_[0, ends])
    begins = np.cumsum(sizes + 1) - sizes - 1  # with end marks
    whole = np.empty(len(codes) + len(ends), np.int64)
    whole[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    whole[begins + sizes] = -1 - np.arange(len(sizes))
    out = []
    most = int(sizes.max(initial=0)) // least_exponent
    for p, places in squares(whole, most):
        cut = np.flatnonzero(np.r_[True, np.diff(places) != 1])
        length = np.diff(np.r_[cut, len(places)]) - 1 + 2 * p
        good = length >= max(least_length, least_exponent * p)
        if good.any():
            out.append((places[cut[good]], length[good], np.full(good.sum(), p)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    start, length, period = map(np.concatenate, zip(*out))
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start - begins[text], length, period


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows together of ``BATCH`` words at most, or one row."""
    begin, words = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if words and words + n > BATCH:
            yield begin, k
            begin, words = k, 0
        words += n
    yield begin, len(sizes)


def periodic_runs(df: DataFrame, least_length: int = 24, least_exponent: int = 3, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row with an array of words (null: none; no word is null).

    ``runs`` (``array<RUN>``, by start, then period) are the stretches of at least ``least_length`` words and
    ``least_exponent`` (2 or more) of their smallest periods that can't be made longer; words count from 0. ``collapsed`` is
    the text without the words that lie in any run after its first period, with one space between words. A narrow stage."""
    if least_exponent < 2:
        raise ValueError("least_exponent must be at least 2")

    def some(keys: pa.Array, rows: pa.ListArray) -> pa.RecordBatch:
        sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        words = rows.flatten()
        numbered = words.dictionary_encode()
        codes = numbered.indices.to_numpy() + np.repeat(np.arange(len(sizes)), sizes) * len(numbered.dictionary)
        text, start, length, period = runs(codes, np.cumsum(sizes), least_length, least_exponent)
        # words that go: steps up where a run's second period begins, down where the run ends
        first = np.cumsum(sizes) - sizes
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, first[text] + start + period, 1)
        np.add.at(steps, first[text] + start + length, -1)
        kept = np.cumsum(steps[:-1]) == 0
        of = np.repeat(np.arange(len(sizes)), sizes)[kept]
        offsets = np.searchsorted(of, np.arange(len(sizes) + 1))
        left = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept)))
        entries = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        bounds = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes), pa.ListArray.from_arrays(bounds, entries), pc.binary_join(left, " ")], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            by = np.argsort(sizes, kind="stable")  # texts of like length have like numbers of levels
            batch, sizes = batch.take(pa.array(by)), sizes[by]
            for a, b in _slices(sizes):
                yield some(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(words_col), F.array().cast("array<string>")).alias("words"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def words(text: Column) -> Column:
    """Words between white space of ASCII; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def repeated(words: Column, begin: Column, period: Column) -> Column:
    """Words whose part from ``begin`` on is their first ``period`` words from there, again and again."""
    i = F.sequence(F.lit(0), F.size(words) - 1)
    return F.transform(i, lambda k: F.get(words, F.when(k < begin, k).otherwise(begin + (k - begin) % period)))


def exercised(words: Column, doc_id: Column) -> Column:
    """Every tenth document, by its id's hash, is given a periodic end (a null id isn't): fixed values of the query."""
    h = F.crc32(doc_id.cast("string"))
    g, n = F.floor(h / 10), F.size(words)
    begin = (g % n).cast("int")
    return F.when((h % 10 == 0) & (n > 0), repeated(words, begin, (1 + F.floor((n - begin) / (3 + g % 8))).cast("int"))).otherwise(words)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("own"))
    found = periodic_runs(docs.select("doc_id", exercised(F.col("own"), F.col("doc_id")).alias("words")))
    # the first of the greatest by cross products, which are exact
    none = F.lit(None).cast(RUN)
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)).alias("best")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")
