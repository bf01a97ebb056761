"""Prefix tables against the tiktoken library, whole, appended and edited."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from veridex.llm import prefix_bpe
from veridex.llm.prefix_bpe import PrefixEncoder

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "Ab", "é", "ing", " the", ".", ",", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "9", "١", "'", "'s", "'ll", "LL", "<|endoftext|>", "中文", "😀", "aaaa", "\x00", "\r\n", "###", "zqj"]


@pytest.fixture(scope="module")
def own():
    return PrefixEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some(rng, most):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


def ids_of(own, text):
    return memoryview(own.encode(text)).cast("i").tolist()


def test_ids_equal_the_library(own, library):
    rng = random.Random(1)
    for text in [some(rng, 15) for _ in range(5000)] + ["", "a" * 5000, " " * 3000, "中" * 2000, "".join(rng.choice("abcde") for _ in range(5000))]:
        assert ids_of(own, text) == library.encode_ordinary(text)


def test_every_prefix_of_a_table_ends_in_its_own_last_token(own, library):
    for text in ("antidisestablishmentarianism", "aaaaaaaaaaaa", "xqzxqzthethe"):
        (last,) = own.table(text).last
        assert last == [library.encode_ordinary(text[: k + 1])[-1] for k in range(len(text))]
        assert [own.walk(last[: k + 1]) for k in range(len(text))] == [library.encode_ordinary(text[: k + 1]) for k in range(len(text))]


def test_two_tokens_stay_apart_where_the_library_keeps_them(own, library):
    rng = random.Random(2)
    for _ in range(5000):
        a, b = rng.randrange(3000), rng.randrange(3000)
        assert own.apart(a, b) == (library._encode_single_piece(own.bytes[a] + own.bytes[b]) == [a, b])


def test_parts_of_a_long_text_are_those_of_the_whole(own):
    rng = random.Random(3)
    for _ in range(500):
        text = some(rng, 40)
        assert [p for part in own.parts(text, 7) for p in part] == own.split(text)
    assert [len(p) for part in own.parts("a" * 100, 7) for p in part] == [100]


def test_appends_and_edits_are_exact(own, library):
    rng = random.Random(4)
    for _ in range(1500):
        of = own.table(some(rng, 30))
        for _ in range(3):
            a = rng.randint(0, len(of.text))
            of = own.replaced(of, a, a + rng.randint(0, 5), some(rng, 5))
            assert own.ids(of) == library.encode_ordinary(of.text)
        of = own.appended(of, some(rng, 5))
        assert own.ids(of) == library.encode_ordinary(of.text)
        assert of == own.table(of.text)


def test_an_edit_of_a_long_piece_works_near_the_edit_alone(own, library, monkeypatch):
    rng = random.Random(5)
    of, looked = own.table("".join(rng.choice("abcdefgh") for _ in range(20000))), []
    extend = own.extend
    monkeypatch.setattr(own, "extend", lambda data, last, stop=None: (looked.append(-len(last)), extend(data, last, stop), looked.append(len(last)))[1])
    new = own.replaced(of, 9000, 9001, "Z")
    assert own.ids(new) == library.encode_ordinary(new.text) and sum(looked) < 1000


def test_forgotten_pieces_are_found_again(own, library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "KNOWN", 3)
    monkeypatch.setattr(prefix_bpe, "PAIRS", 3)
    text = "one two three four five one two six seven one eight two " * 3
    assert ids_of(PrefixEncoder(PATH), text) == library.encode_ordinary(text)


def test_a_token_that_no_merge_gives_is_an_error(tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for k, t in enumerate([b"a", b"b", b"aba"])))
    with pytest.raises(ValueError, match="no merge"):
        PrefixEncoder(str(path))


def test_query(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    rows = prefix_bpe.op11_prefix_bpe(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "same"), (3, "same"), (4, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    got = prefix_bpe.decoded(prefix_bpe.encoded(df)).collect()
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == sorted((str(k), library.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows)
    assert prefix_bpe.encoded(df.limit(0)).count() == 0
    assert prefix_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == b""


def test_ids_are_decoded_in_parts_and_unknown_ones_refused(own, library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "DECODED", 7)
    rng = random.Random(9)
    for _ in range(300):
        ids = np.array([rng.randrange(own.size) for _ in range(rng.randint(0, 30))], np.int32)
        assert own.decode(ids) == library.decode_bytes(ids.tolist())
    for bad in (-1, own.size):
        with pytest.raises(ValueError, match="vocabulary"):
            own.decode(np.array([1, bad]))


def test_edits_of_rows(spark, library):
    df = spark.createDataFrame([(1, "one two three", 4, 7, "2"), (2, None, 0, 0, "new"), (3, "the end", 10**9, 10**9, "ing of it"), (4, "cut me", 3, 6, None)], "doc_id long, text string, start long, stop long, new string")
    first = prefix_bpe.tables(df).select("doc_id", "text", "ends", "last")
    got = {r.doc_id: (r.text, r.ids) for r in prefix_bpe.edited(first.join(df.drop("text"), "doc_id")).collect()}
    assert got == {k: (t, library.encode_ordinary(t)) for k, t in {1: "one 2 three", 2: "new", 3: "the ending of it", 4: "cut"}.items()}
