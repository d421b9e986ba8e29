"""Encoding of a corpus with a byte-level BPE tokenizer, exactly, by dynamic programming over prefixes.

For every prefix of a piece of text the encoding's last token is unique: of the tokens that end there it is the one
which fits behind the last token of the prefix before it. Two tokens fit when encoding their joined bytes gives them
back, which the merge table tells without encoding anything. So one pass from left to right stores one token per
prefix, and following the tokens' lengths back from the end gives the ids. Tokens ending at a position come from the
suffix links of an automaton over the vocabulary.

Null and empty texts give an empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.session import ship

#: Folder of the vocabulary files; every executor must have it.
TOKENIZERS = os.environ.get("CODEWEFT_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how texts are cut into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces remembered per worker.
MEMO = 300_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """A vocabulary, its merges, and the automaton over it."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        vocab = {word: i for word, i in model["vocab"].items() if all(c in letters for c in word)}
        self.size = {i: len(word) for word, i in vocab.items()}
        #: Merge of two ids -> (rank, id); halves of an id, for single bytes absent.
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = whole
            if whole not in self.halves:
                self.halves[whole] = vocab[a], vocab[b]
                self.rank[whole] = k
        self.ends = ahocorasick.Automaton()
        for word, i in vocab.items():
            if len(word) == 1 or i in self.halves:
                self.ends.add_word(raw(word).decode("latin-1"), i)
        self.ends.make_automaton()
        self.split = regex.compile(PIECES).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, array] = {}

    def fit(self, left: int, right: int) -> bool:
        """Would encoding the bytes of both tokens give these two?

        Going backwards through both tokens' merges, latest first, no merge across the seam may come before the merge
        that made the part at the seam: such a merge would have been done first."""
        key = left, right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
            got = self.fits[key] = self._fit(left, right)
        return got

    def _fit(self, a: int, b: int) -> bool:
        rank, halves, merged = self.rank, self.halves, self.merged
        # Merges at the seam that come at or after `limit` had lost one of their sides by then. Of equal merges the
        # left one is done first, so one that ties with the left token's making may not come first, with the right's may.
        limit, ties = float("inf"), False
        while True:
            across = merged.get((a, b))
            if across is not None and (rank[across] < limit or ties and rank[across] == limit):
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, ties, a = ra, False, halves[a][1]
            else:
                limit, ties, b = rb, True, halves[b][0]

    def piece(self, text: str) -> array:
        """The ids of one piece."""
        data = text.encode("utf-8").decode("latin-1")
        size, fit = self.size, self.fit
        last = array("i", [-1]) * (len(data) + 1)
        for end, token in self._endings(data):
            if last[end] < 0:
                begin = end - size[token]
                if begin == 0 or last[begin] >= 0 and fit(last[begin], token):
                    last[end] = token
        out = array("i")
        at = len(data)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    def _endings(self, data: str) -> Iterator[tuple[int, int]]:
        """(end, token) for every token that ends at each position, positions in order, longest token first."""
        for end, token in self.ends.iter(data):
            yield end + 1, token

    def encode(self, text: str) -> array:
        memo, out = self.memo, array("i")
        for p in self.split(text):
            got = memo.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) < 200:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[p] = got
            out.extend(got)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """`key` and `ids` of each row, null or empty texts included. A map over the rows: nothing is shuffled."""
    ship(docs.sparkSession)
    path = f"{folder or TOKENIZERS}/{name}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            flat, offsets = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(enc.encode(t))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32) if len(offsets) else [], pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`key` and `tokens`, the number of ids of each row's text."""
    return encode_column(docs, key, text, **options).select(key, F.size("ids").cast("long").alias("tokens"))


def available(spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None) -> bool:
    return os.path.exists(f"{folder or TOKENIZERS}/{name}.json")
