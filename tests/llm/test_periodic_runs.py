"""Runs by refinement against trying every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm import periodic_runs
from veridex.llm.periodic_runs import runs

SF = "/root/testdata/sf0.001"


def tried(words, least_length, least_exponent):
    """Every run as ``start, length, period``, by comparing words a period apart."""
    n, out = len(words), []
    for q in range(1, n // least_exponent + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(least_length, least_exponent * q):
                part = words[at : at + length]
                if not any(part[r:] == part[: length - r] for r in range(1, q)):
                    out.append((at, length, q))
            at = end + 1 if end == at else end
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 4 else 0):
        begin, period = rng.randrange(n), rng.randint(1, n // 4)
        for k in range(begin, rng.randint(begin, n)):
            words[k] = words[begin + (k - begin) % period]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = rng.randrange(letters)
    return words


@pytest.mark.parametrize("few", [0, 3, 40])
def test_runs_equal_those_by_trying(few, monkeypatch):
    monkeypatch.setattr(periodic_runs, "FEW", few)
    rng = random.Random(few)
    for _ in range(200):
        least = rng.choice([(2, 2), (24, 3), (6, 3), (4, 2)])
        texts = [planted(rng, rng.choice([0, 1, 2, 5, 30, 80, 150]), rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(1, 6))]
        codes = np.array([k * 1000 + x for k, words in enumerate(texts) for x in words], np.int64)
        found = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in runs(codes, np.cumsum([len(w) for w in texts]), *least))):
            found[text].append(tuple(run))
        assert found == [tried(words, *least) for words in texts]


def test_classes_stay_stretches_of_one_array():
    codes = np.r_[np.tile(np.array([0, 1, 0, 2]), 60), -1]
    r = periodic_runs.Refinement(codes)
    for _ in range(80):
        p = r.level
        whole = {}
        for k in range(len(codes) - p):
            whole.setdefault(tuple(codes[k : k + p]), []).append(k)
        for members in whole.values():
            c = r.of[members[0]]
            stretch = r.order[r.start[c] : r.start[c] + r.size[c]]
            assert sorted(stretch) == members and r.next[members].tolist() == [*members[1:], -1]
        r.advance()


def test_a_long_periodic_text_takes_few_steps_a_level(monkeypatch):
    looked = []
    few = periodic_runs.Refinement._few
    monkeypatch.setattr(periodic_runs.Refinement, "_few", lambda self, fresh: (looked.append(len(fresh)), few(self, fresh))[1])
    n = 60_000
    _, start, length, period = runs(np.arange(n) % 7, np.array([n]), 24, 3)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [7]) and sum(looked) < 2 * n


def brute(doc_id, text):
    """The query's row, straight from its definition."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = tried(words, 24, 3)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = best and 1000 * best[1] // best[2]
    return (doc_id, len(found), *(best or (None,) * 3), milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 15000]
    rows = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert all(rows[k] == brute(k, t) for k, t in texts) and len(texts) > 100
    assert sum(r[1] > 0 for r in rows.values()) > 5


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "word", "a b " * 40, ("x " * 30 + "y ") * 4, "a\x85b\x1cc " * 30, "λ " * 50]
    texts += [" ".join(map(str, planted(rng, 120, 3))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "runs": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute(*r) for r in rows), key=repr)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a a a".split()), (2, []), (2, []), (3, ["b"] * 30)], "doc_id long, words array<string>").withColumn("collapsed", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()), key=repr)
    assert got == sorted([(1, 0, [], ""), (None, 3, [], "a a a"), (2, 0, [], ""), (2, 0, [], ""), (3, 30, [(0, 30, 1)], "b")], key=repr)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="exponent"):
        periodic_runs.periodic_runs(df, least_exponent=1)


def test_a_null_id_is_not_exercised(spark):
    words = [str(k) for k in range(50)]
    df = spark.createDataFrame([(None, words)], "doc_id long, words array<string>")
    assert df.select(periodic_runs.exercised(F.col("words"), F.col("doc_id"))).first()[0] == words
