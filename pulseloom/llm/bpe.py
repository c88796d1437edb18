"""Byte-pair encoding and decoding with a published tokenizer file.

Encoding: each pre-token starts as a doubly linked list of symbols; a priority queue holds the merges of
adjacent symbols by rank; a popped entry whose symbols have changed since is stale and skipped.  Decoding
concatenates the vocabulary's strings, with a blank between them where the file names no decoder.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseloom.llm.common import byte_slices, small_batches, tidy

#: Bytes about that each cache of a worker holds before it starts anew; bytes of text taken at once.
CACHED, SLICE = 24 << 20, 4 << 20
#: Bytes of an entry besides its text and value.
ENTRY = 220
#: Characters on which every version of Unicode agrees, each a normal form whatever follows it among them.
LATIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-\xff]*")
#: A word and what follows it, where the rules of the file split between the two only.
SIMPLE = regex.compile("([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: a printable byte is itself, the n-th other one is U+0100 + n."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merge_ranks(symbols: list[int], merges: list[dict[int, int] | None]) -> list[int]:
    """Merge adjacent symbols, always the pair of least rank, leftmost first.

    merges: for each left symbol, right symbol to ``rank << 20 | merged``. A queue entry is ``rank << 40 | place``; it is
    stale if the pair that now begins at the place has another rank, or none.
    """
    queue = []
    left = symbols[0]
    for i, right in enumerate(symbols[1:]):
        if (of := merges[left]) is not None and (m := of.get(right)) is not None:
            queue.append(m >> 20 << 40 | i)
        left = right
    if not queue:
        return symbols
    n = len(symbols)
    symbols = [*symbols, -1]
    before, after = list(range(-1, n)), list(range(1, n + 2))
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFFFF
        if (left := symbols[i]) < 0 or (of := merges[left]) is None:
            continue
        j = after[i]
        m = of.get(symbols[j])
        if m is None or m >> 20 != entry >> 40:
            continue
        symbols[i] = merged = m & 0xFFFFF
        symbols[j] = -1
        after[i] = k = after[j]
        before[k] = i
        if (of := merges[merged]) is not None and (m := of.get(symbols[k])) is not None:
            push(queue, m >> 20 << 40 | i)
        if (h := before[i]) >= 0 and (of := merges[symbols[h]]) is not None and (m := of.get(merged)) is not None:
            push(queue, m >> 20 << 40 | h)
    return [s for s in symbols if s >= 0]


class Remembered(dict):
    """A dict that works out missing values and forgets those not asked for while as many others came."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before, self.left = make, {}, CACHED

    def __missing__(self, key):
        if (value := self.before.get(key)) is None:
            value = self.make(key)
        if len(key) < 64:
            if self.left <= 0:
                self.before = dict(self)
                self.clear()
                self.left = CACHED
            self[key] = value
            self.left -= ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        return value


def blank_split(text: str) -> list[str]:
    """Parts of a text between blanks and line ends."""
    text = text.replace("\n", " ")
    if "\t" in text or "\r" in text:
        text = text.replace("\t", " ").replace("\r", " ")
    return text.split(" ")


class WordBpe:
    """Encoder and decoder of a BPE tokenizer file with NFC, white-space and lower-case normalisers and word-end suffix."""

    def __init__(self, spec: str):
        library = Tokenizer.from_str(spec)
        self.normal, self.pre = library.normalizer, library.pre_tokenizer
        spec = json.loads(spec)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"] or spec["decoder"]:
            raise ValueError("not a tokenizer file of the supported kind")
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if max(vocab.values()) >= 1 << 20:
            raise ValueError("a vocabulary of more than 2**20 strings")
        self.merges: list[dict[int, int] | None] = [None] * (max(vocab.values()) + 1)
        for rank, (a, b) in enumerate(pairs):
            own = self.merges[vocab[a]] = self.merges[vocab[a]] or {}
            own.setdefault(vocab[b], rank << 20 | vocab[a + b])
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        self.inner = [vocab[c] for c in byte_letters()]
        self.last = [vocab[c + self.end] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        self.packed = Remembered(lambda word: array("i", self._word(word)).tobytes())
        self.chunks = Remembered(self._chunk)

    def _word(self, word: str | bytes) -> list[int]:
        raw = word.encode() if isinstance(word, str) else word
        return merge_ranks([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.merges)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text between two blanks: no rule of the file reaches across one."""
        if m := SIMPLE.fullmatch(chunk):
            return self.packed[m[1].lower()] + (self.packed[m[2]] if m[2] else b"")
        return self._general(chunk)

    def _general(self, chunk: str) -> bytes:
        ids: list[int] = []
        for part in self.marks.split(chunk) if self.marks and "<" in chunk else (chunk,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if LATIN.fullmatch(part):
                for word in self.pieces.findall(part.lower()):
                    ids.extend(self._word(word))
            else:  # the library's own tables of normal forms, cases and classes
                for word, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(part)):
                    ids.extend(self._word(bytes(map(self.letters.__getitem__, word))))
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, blank_split(text))), np.int32)

    def tokens(self, ids) -> list[str]:
        return list(map(self.strings.__getitem__, ids))

    def decode(self, ids) -> str:
        return " ".join(self.tokens(ids))


def _list_array(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def bpe_encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row; ``spec`` is the content of the tokenizer file.

    The ids are those of the file's own library without special tokens added, truncation or padding. Null and
    empty texts give an empty array; repeated rows and null ids each give a row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        coder = WordBpe(sent.value)
        for batch in batches:
            text = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
            for a, b in byte_slices(sizes, SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _list_array([coder.encode(t or "") for t in text.slice(a, b - a).to_pylist()])], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, spec: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the vocabulary's strings of the ids, special tokens too, concatenated.

    Empty or null ids give an empty text; an id outside the vocabulary is an error.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        coder = WordBpe(sent.value)
        for batch in batches:
            ids = batch.column(1)
            for a, b in byte_slices([4 * (n or 0) for n in pa.compute.list_value_length(ids).to_pylist()], SLICE // 2):
                part = ids.slice(a, b - a)
                strings = coder.tokens(part.flatten().to_numpy().tolist())
                ends = np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(part).to_pylist())]).tolist()
                texts = [" ".join(strings[x:y]) for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, text string")
