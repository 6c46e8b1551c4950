"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word exactly one token can be the last one of the prefix's
BPE encoding. Going through the word once, an automaton lists the tokens that
end at each position (longest first); the first one that is compatible with the
token stored for the prefix before it is stored, and following these
back-pointers from the end gives the ids. Time is linear in the word's length,
so a run of 100,000 letters without a space costs no more per letter than prose.

Two neighbouring tokens are compatible if BPE, run over both, would give these
two again. That is found by taking both apart again, latest merge first: when a
merge over the seam would have come before the merge being taken apart, BPE
would have joined across the seam and the pair can't occur.

The automaton is the pyahocorasick package's, built over the vocabulary: its state
after a letter is the longest suffix read that begins a token, and its suffix links
lead to all tokens that end there, which is what a suffix automaton would be asked
for. Prefixes, compatibility and back-pointers are worked out here; no tokenizer is
called for the merges.

Edge cases: null text is the empty text; it has no ids, and its decoded text is
empty. The strings of special tokens in a text become their ids, as in the
tokenizers library. Columns beside doc_id and text are ignored by the query and
kept by ``encode_column``; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brassloom.llm.common import cached, ship, small_batches, table

#: Words, and pairs of tokens, that a worker remembers in each of two generations.
REMEMBER = 150_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Bpe:
    """A word-level BPE vocabulary, read from a tokenizers file whose words end in a suffix such as ``</w>``."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("ignore_merges") or not model["end_of_word_suffix"]:
            raise ValueError("only vocabularies with word ends, without unknown tokens and prefixes")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = {x: i for i, x in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            """A token as one letter per symbol: its byte, plus 256 if the word ends with it."""
            stem, last = (token[: -len(end)], 256) if token.endswith(end) and len(token) > len(end) else (token, 0)
            codes = [letters[c] for c in stem]
            codes[-1] += last
            return "".join(map(chr, codes))

        self.token = {i: t for t, i in vocab.items()}
        self.first: dict[int, int] = {}  # the two halves of a merged token
        self.second: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}  # a pair's rank and merged token
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, xy = vocab[a], vocab[b], vocab[a + b]
            self.joined.setdefault((x, y), (rank, xy))
            if xy not in self.rank:
                self.first[xy], self.second[xy], self.rank[xy] = x, y, rank
        self.base = {symbols(t): i for t, i in vocab.items() if len(symbols(t)) == 1}
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            s = symbols(t)
            if self._whole(s, i):
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)

        # What is taken from the text before BPE. The library's own steps serve letters outside this range, whose classes depend on the version of Unicode.
        self.normalizer, self.splitter = (t := Tokenizer.from_file(path)).normalizer, t.pre_tokenizer
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this vocabulary normalizes in another way")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("this vocabulary splits in another way")
        usual = [chr(c) for c in [*range(0x1C), *range(0x20, 0x234), *range(0x2010, 0x2028), 0x20AC]]
        letter, number, white = ("".join(map(re.escape, filter(f, usual))) for f in (str.isalpha, lambda c: unicodedata.category(c)[0] == "N", regex.compile(r"\s").match))
        self.usual = re.compile(f"[{re.escape(''.join(usual))}]*").fullmatch
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{white}{letter}{number}]+").findall
        self.unletter = {x: bytes([i]) for i, x in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def _whole(self, s: str, token: int) -> bool:
        """Whether BPE joins a token's own symbols to it; a token that it never reaches can't occur."""
        parts = [self.base[c] for c in s]
        while len(parts) > 1:
            found = min(((self.joined[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.joined), default=None)
            if found is None:
                return False
            k = found[1]
            parts[k : k + 2] = [self.joined[parts[k], parts[k + 1]][1]]
        return parts == [token]

    def _compatible(self, left: int, right: int) -> bool:
        rank, before = self.rank, len(self.joined)
        while True:
            over = self.joined.get((left, right))
            if over is not None and over[0] < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token's last merge is the later one; of equal merges BPE takes the one further left first
                left, before = self.second[left], a
            else:
                right, before = self.first[right], b + 1

    def word_ids(self, word: bytes) -> tuple[int, ...]:
        """A word's ids, by the last token of each prefix."""
        n = len(word)
        if not n:
            return ()
        s = word[:-1].decode("latin-1") + chr(word[-1] + 256)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, done = self.pairs, 0
        for end, (token, length) in self.automaton.iter(s):
            k = end + 1
            if k == done:
                continue
            if k > length:
                before = last[k - length]
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = pairs[before << 32 | token] = self._compatible(before, token)
                if not fits:
                    continue
            last[k], size[k], done = token, length, k
        out, k = [], n
        while k:
            out.append(last[k])
            k -= size[k]
        return tuple(reversed(out))

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        ids = array("I")
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.words.__getitem__, self._split(part))))
        return ids

    def _split(self, text: str) -> list:
        self.words.age()
        if len(self.pairs) > REMEMBER * 2:
            self.pairs.clear()
        if self.usual(text):  # white space that becomes one space is dropped all the same, and no word goes over it
            return unicodedata.normalize("NFC", text).lower().split()
        said = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [b"".join(map(self.unletter.__getitem__, w)) for w, _ in said]

    def decode(self, ids) -> str:
        """The tokens of ids with a space between each two: a vocabulary without a decoder has no other text."""
        return " ".join(map(self.token.__getitem__, ids))


class _Words(dict):
    """The ids of what this worker has met: texts between white space, and words by their bytes.

    When it is full, its words become the older generation, from which those that occur again come back.
    """

    def __init__(self, bpe: Bpe):
        self.bpe, self.older = bpe, {}

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            if isinstance(word, bytes):
                found = self.bpe.word_ids(word)
            elif len(parts := self.bpe.split(word)) == 1:
                found = self.bpe.word_ids(word.encode())
            else:
                found = tuple(chain.from_iterable(map(self.__getitem__, parts)))
        self[word] = found
        return found

    def age(self) -> None:
        if len(self) > REMEMBER:
            self.older = dict(self)
            self.clear()


@lru_cache(2)
def vocabulary(path: str) -> Bpe:
    """Read once per worker."""
    return Bpe(path)


cached("bpe", vocabulary.cache_clear)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_column(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids (array of long) of its text and the text decoded from them.

    path: the vocabulary file, which every executor must have; None: the installed one.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path or default_path())
        for batch in small_batches(batches, "bpe"):
            found = [bpe.encode(x or "") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([bpe.decode(x) for x in found], pa.string())],
                names=[*kept, ids, decoded],
            )

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.LongType())), T.StructField(decoded, T.StringType())])
    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: what ``encode_column`` gives, digested where it is made."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path or default_path())
        for batch in small_batches(batches, "bpe"):
            n, of_ids, of_text = [], [], []
            for x in batch.column(1).to_pylist():
                ids = bpe.encode(x or "")
                n.append(len(ids))
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                of_ids.append(hashlib.sha256(_little(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _little(ids: array) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    if ids.itemsize != 4:
        ids = array("L", ids)
    if sys.byteorder == "big":
        ids = array(ids.typecode, ids)
        ids.byteswap()
    return ids.tobytes()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
