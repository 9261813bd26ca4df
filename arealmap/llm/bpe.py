"""BPE encoding and decoding for tokenizer files with word ends.

Encoding is by backtracking.  An Aho-Corasick automaton over the vocabulary
finds the longest token at every place of a word in one pass; the encoder
takes the longest token that may follow the one before it, goes to shorter
prefixes where it may not, and steps back from dead ends, which it marks so
that none is entered twice.  Whether a token may follow another is a question
of the merge ranks alone: no merge across their border may come before the
merges that made the two.  The result equals merging by rank, in linear time.

Decoding gathers bytes from one blob through an offset table.

Defined cases: a null text is empty; an empty or blank text has no tokens; the
strings of special tokens in a text become those tokens; ids outside the table
are refused; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_at_a_time, worker_cache

#: Words that a worker remembers; memory only, results don't depend on it.
CACHE_WORDS = 300_000
#: Rows of one output batch.
ROWS = 256
#: The word pattern of the tokenizer file; white space as its library has it.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Where the last byte of a word is put, apart from the other bytes.
LAST = 0x4000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """The ids, as bytes, of the words seen so far; long words are encoded anew each time."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), np.int32).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Tokenizer:
    """Built from the text of a tokenizer file."""

    def __init__(self, source: str):
        told = json.loads(source)
        model = told["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or [x["type"] for x in told["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word-end BPE tokenizer file of the kind that this encoder reads")
        vocab, merges = model["vocab"], [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()
        inside = {k: i for k, i in vocab.items() if k not in self.special}
        spelt = {self._spell(k): i for k, i in inside.items()}
        self.length = {i: len(k) for k, i in spelt.items()}
        self.parts = {vocab["".join(x)]: (vocab[x[0]], vocab[x[1]]) for x in merges}
        self.merged = {x: i for i, x in self.parts.items()}
        made = [vocab["".join(x)] for x in merges]
        if made != sorted(made) or any(max(x) >= i for i, x in self.parts.items()):
            raise ValueError("the ids of merged tokens must rise with their rank")
        self.shorter = {}
        self.automaton = ahocorasick.Automaton()
        for k, i in spelt.items():
            self.automaton.add_word(k, (len(k), i))
            self.shorter[i] = next((spelt[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in spelt), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words = _Words(self.encode_word)
        # The pattern over lower-cased text; texts of ASCII alone have a plainer form of it.
        self.find = regex.compile(WORD.replace(r"\s", SPACES)).findall
        self.find_latin = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµº\xdf-\xf6\xf8-\u017f]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµº\xdf-\xf6\xf8-\u017f0-9²³¹¼½¾]+").findall
        self.find_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self._table(vocab)

    def _spell(self, key: str) -> str:
        """A token over the encoder's own alphabet, in which a word's last byte is another letter."""
        return key[: -len(END) - 1] + chr(LAST + ord(key[-len(END) - 1])) if key.endswith(END) and key != END else key

    def _table(self, vocab: dict[str, int]) -> None:
        tokens = {**{i: k for k, i in vocab.items()}, **{i: k for k, i in self.special.items()}}
        if sorted(tokens) != list(range(len(tokens))):
            raise ValueError("token ids must be gapless")
        pieces = [tokens[i].encode() + b" " for i in range(len(tokens))]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side.

        Walk the border back through the merges that made the two tokens, latest merge
        first; a merge across the border that ranks before the merge just undone would have won.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        bound, good = len(self.sizes), True
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                good = False
                break
            # Undo the later of the two merges; of equal ids the right one comes later.
            for side in ((0, 1) if left > right else (1, 0)):
                token = left if side == 0 else right
                if token in self.parts:
                    if side == 0:
                        bound, left = token, self.parts[token][1]
                    else:
                        bound, right = token + 1, self.parts[token][0]
                    break
            else:
                break
        if len(self.fits) >= CACHE_WORDS:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        spelt = "".join([self.letters[b] for b in data[:-1]]) + chr(LAST + ord(self.letters[data[-1]]))
        n = len(spelt)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(spelt):
            longest[end - size + 1] = token
        out: list[int] = []
        open_ends, at, token = [True] * (n + 1), 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.length[token]
                if open_ends[end] and (last < 0 or self.may_follow(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                open_ends[at] = False
                token = self.shorter[out.pop()]
                at -= self.length[last]
        return out

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            found = self.find_ascii(text.lower())
        else:
            # Lower-casing is by single letters, so a final sigma is like any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            found = (self.find_latin if max(text) < "\u0180" else self.find)(text)
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        if self.special_cut is None or "<|" not in text:
            parts = self._plain(text)
        else:
            parts = b"".join(np.int32(self.special[x]).tobytes() if x in self.special else self._plain(x) for x in self.special_cut.split(text))
        return np.frombuffer(parts, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings, one space between; UTF-8."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.sizes):
            raise ValueError("an id is not in the table")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[places].tobytes()[:-1]


def _tokenizer(source: str) -> Tokenizer:
    return worker_cache(("bpe", hash(source)), lambda: Tokenizer(source))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's whole text, decoded from the ids.

    ``path`` is a tokenizer file on the driver; its text, a few megabytes whatever
    the data, goes to the executors by broadcast.
    """
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(source.value)
        for batch in few_at_a_time(batches):
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = [coder.encode(x or "") for x in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                texts = pa.array([coder.decode(x).decode() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, texts], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
