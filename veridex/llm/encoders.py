"""Ids of whole texts as the tokenizers library gives them, at a fraction of its cost.

``encoder(path)`` picks by the file's own settings; every encoder yields little-endian uint32 bytes per text, without
begin or end tokens, truncation or padding, and with special strings inside texts taken as the library takes them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokenizer's pattern of byte-level BPE files; a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level files: itself where printable, else the next from
    256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeRanks:
    """Byte-level BPE: the file's own merges, run by tiktoken.

    It relies on what ``fits`` checks: ids of merged tokens in the order of their merges, the usual pre-tokenizer
    without a space before the text, no normaliser, no other model options.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.size = len(ranks) + len(special)
        self.library = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def fits(spec: dict) -> bool:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or spec.get("normalizer") or spec.get("post_processor") or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        merges = [m.replace(" ", "", 1) if isinstance(m, str) else m[0] + m[1] for m in model["merges"]]
        ids = [model["vocab"][m] for m in merges]
        return all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"]) and ids == sorted(ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield self.library.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


class WordMerges:
    """A vocabulary with word ends, its merges run by tiktoken. A zero byte stands for a word's end: joined to the byte
    before it first of all, it makes the symbols that the model begins with."""

    def __init__(self, model: dict):
        import tiktoken

        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"], byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        ids = [vocab[c] for c in letters] + [vocab[c + suffix] for c in letters]
        for merge in model["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            word = token.removesuffix(suffix)
            ranks[bytes(byte[c] for c in word) + b"\0" * (word != token)] = len(ids)
            ids.append(vocab[token])
        self.ids = np.array(ids, "<u4")
        self.ends = np.zeros(len(ids), bool)
        for token, rank in ranks.items():
            self.ends[rank] = token[-1] == 0 and rank
        self.run = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, pre-tokens in lower case without zero bytes, none of them empty, and where each
        one's end."""
        found = self.run("\0".join([*words, ""]), disallowed_special=())
        return self.ids[found], np.flatnonzero(self.ends[found]) + 1


class PieceCache:
    """Vocabularies that drop white space: a text's ids are the ids of the pieces between spaces and line ends, in order.

    Arrow splits a group of texts and numbers its distinct pieces; each that isn't known yet is encoded once, and numpy
    gathers the ids of all pieces from one array. Most pieces are a Latin word and then ASCII punctuation, if any: lower
    case is all that the normaliser does to these, and the model's merges alone give the ids of each of the two. All
    other pieces go through the whole library. ``limit`` bounds the known pieces, and ``LONG`` the length of one that is
    kept, and so the worker's memory.

    It relies on what ``fits`` checks: the normaliser's and pre-tokenizer's steps by name, an end-of-word suffix that
    every word's last symbol has, no other model options, and special strings with ``<`` and without white space.
    """

    LONG = 64

    #: Without the apostrophe, which begins contractions, and <, which begins special strings.
    WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@[-`{-~]*)")

    #: For RE2: Latin texts; and those in which a full stop or comma stands beside other punctuation.
    LATIN = r"\A[\x00-\x7fÀ-ÖØ-öø-ÿ]*\z"
    NOT_ALONE = r"[.,][!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]|[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f][.,]|<\|"

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.merges = WordMerges(json.load(f)["model"])
        self.limit = limit
        self._forget()

    @staticmethod
    def fits(spec: dict) -> bool:
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        model = spec["model"]
        usual = model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        special = [t["content"] for t in spec["added_tokens"]]
        return bool(usual) and steps == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and all("<" in t and not re.search(r"\s", t) for t in special)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(texts), 2000):
            found += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return found

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a piece's number; its ids are flat[ends[number] : ends[number + 1]]
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that aren't words in lower case."""
        rest, parts, words, whole = [], [], {}, self.WORD.fullmatch
        for p in pieces:
            if (m := whole(p)) is None:
                rest.append(p)
                parts.append(None)
            else:
                parts.append((m[1].lower(), m[2]))
                words.update(dict.fromkeys(filter(None, parts[-1])))
        ids, ends = self.merges.encode(list(words))
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        of = dict(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)])) | {"": b""}
        others = iter(self._library(rest))
        return [next(others) if ab is None else of[ab[0]] + of[ab[1]] for ab in parts]

    def _append(self, pieces: list[str]) -> list[str]:
        """Adds the ids of the pieces, in an order of its own, which it returns."""
        simple = pc.match_substring_regex(pa.array(pieces, pa.large_string()), r"\A[a-z]+\z").to_pylist()
        words = list(compress(pieces, simple))
        others = [p for p, yes in zip(pieces, simple) if not yes]
        ids, ends = self.merges.encode(words)
        more = self._others(others)
        size = np.fromiter(map(len, more), np.int64, len(more)) // 4
        at = self.ends[-1] + len(ids)
        self.flat = np.concatenate([self.flat, ids, np.frombuffer(b"".join(more), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends, at + np.cumsum(size)])
        return words + others

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Works in groups of a few MB of text."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > 5_000_000:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces, the number of each piece among these, and the texts' bounds in pieces.

        Where a text is Latin and its full stops and commas stand alone, it is taken in lower case and these are pieces
        of their own, so that fewer pieces differ."""
        column = pa.array(texts, pa.large_string())
        alone = pc.and_not(pc.match_substring_regex(column, self.LATIN), pc.match_substring_regex(column, self.NOT_ALONE))
        lower = pc.replace_substring(pc.replace_substring(pc.utf8_lower(column), ".", " ."), ",", " ,")
        pieces = pc.split_pattern(pc.replace_substring(pc.if_else(alone, lower, column), "\n", " "), " ")
        numbered = pieces.flatten().dictionary_encode()
        return numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy(), pieces.offsets.to_numpy()

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        names, codes, bounds = self._split(texts)
        if len(self.known) > self.limit:
            self._forget()
        numbers = list(map(self.known.get, names))
        new = [p for p, k in zip(names, numbers) if k is None]
        short = self._append([p for p in new if len(p) <= self.LONG])
        self.known.update(zip(short, range(len(self.known), len(self.known) + len(short))))
        long = self._append([p for p in new if len(p) > self.LONG])
        at = dict(zip(long, range(len(self.known), len(self.known) + len(long))))
        if new:
            numbers = [(self.known[p] if p in self.known else at[p]) if k is None else k for p, k in zip(names, numbers)]
        numbers = np.array(numbers, np.int64)
        size = np.diff(self.ends)[numbers][codes]
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        ids = self.flat[np.repeat(self.ends[numbers][codes] - after[:-1], size) + np.arange(after[-1])]
        self.ends = self.ends[: len(self.known) + 1]  # long pieces go again
        self.flat = self.flat[: self.ends[-1]]
        cuts = after[bounds].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b].tobytes()


class WholeTexts:
    """Any other file: the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, MergeRanks | PieceCache | WholeTexts] = {}


def encoder(path: str) -> MergeRanks | PieceCache | WholeTexts:
    """The worker's own encoder for a file; it lives as long as the worker does."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _encoders[path] = next((kind for kind in (MergeRanks, PieceCache) if kind.fits(spec)), WholeTexts)(path)
    return _encoders[path]
