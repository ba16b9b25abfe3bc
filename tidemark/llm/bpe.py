"""Byte-level BPE encoding and decoding by a pair occurrence index.

A partition's texts are cut into pre-tokens; the distinct ones that were not seen before lie end to end as one array of
symbols with previous and next links. The index lists, by rank, all positions of each pair that has one. Ranks are applied in
ascending order, a block of ranks at a time (``_steps``): within a block each pre-token merges the occurrences of its lowest rank
from left to right, the pairs that a merge makes enter the lists, and entries whose symbols have changed since are dropped, until no
rank of the block is left. A merge needs symbols that an earlier rank made (``PairIndexEncoder`` refuses files where that is not so),
so each pre-token gets exactly the ids that merging it alone, rank by rank, would give.

Texts are taken ``CHARS`` bytes at a time, a longer one alone, so memory follows the longest text and not the partition. Ids of
pre-tokens are remembered within a task up to ``MEMORY`` entries, then forgotten as a whole; this bounds memory and changes no
result. The tokenizer is read from a ``tokenizers`` JSON file whose path is a parameter; the driver reads it and broadcasts its
content, whose size is checked against ``LARGEST_FILE``. Files that ask for more than byte-level BPE with the split pattern below
(normalizers, other pre-tokenizers, added tokens that strip or match whole words, dropout, byte fallback) are refused.

Special tokens of the file that occur in a text are their own ids, as that library does. Decoding gathers the bytes of ids
and replaces malformed UTF-8, special tokens included.

Defined results: a null or empty text has no ids and decodes to the empty text; null ids decode to the empty text; repeated rows
give a row each, a null doc_id stays null; an empty table gives no rows; other columns are not read by ``encode``, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII only, where the classes are plain ranges.
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
MEMORY = 1 << 18
CHARS = 2 << 20
LARGEST_FILE = 16 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _steps(ranks: int) -> list[int]:
    """The ends of blocks of ranks: narrow first, as low ranks merge most, each a quarter wider than all before it."""
    ends = [16]
    while ends[-1] < ranks:
        ends.append(ends[-1] + max(16, ends[-1] // 4))
    return ends


def _refused(spec: dict) -> str | None:
    """What a tokenizer file asks for that is not done here."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE":
        return "a model other than BPE"
    for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
        if model.get(name):
            return name
    if spec.get("normalizer"):
        return "a normalizer"
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return "a pre-tokenizer other than the plain byte-level one"
    if any(x.get(name) for x in spec["added_tokens"] for name in ("single_word", "lstrip", "rstrip", "normalized")):
        return "added tokens that strip, match whole words or normalize"
    return None


class PairIndexEncoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizers file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        if why := _refused(spec):
            raise ValueError(f"the tokenizer file has {why}")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        bytes_of = {i: raw(token) for token, i in vocab.items()} | {i: c.encode() for c, i in self.special.items()}
        size = max(bytes_of) + 1
        self.lengths = np.array([len(bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(size)), np.uint8)
        made: dict[int, int] = {}  # merged id -> lowest rank
        left, right, merged = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(vocab[a])
            right.append(vocab[b])
            merged.append(vocab[a + b])
            made.setdefault(merged[-1], rank)
        if any(max(made.get(a, -1), made.get(b, -1)) >= rank for rank, (a, b) in enumerate(zip(left, right, strict=True))):
            raise ValueError("a merge needs a symbol of a later one")
        self.left, self.right, self.merged = (np.array(x, np.int64) for x in (left, right, merged))
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")  # of a repeated pair the lowest rank counts
        self.keys, at = np.unique(keys[order], return_index=True)
        self.ranks = order[at]
        self.steps = _steps(len(left))
        self.words = regex.compile(PATTERN)
        self.ascii_words = re.compile(ASCII_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1) if len(self.keys) else np.full(len(a), -1)

    def learn(self, words: list[str]) -> None:
        """Finds the ids of new pre-tokens, all together."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes + 1) - 1  # each word is followed by a -1 that no pair crosses
        symbols = np.full(int(ends[-1]) + 1, -1, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[ends] = False
        symbols[inside] = self.first[np.frombuffer(b"".join(data), np.uint8)]
        owner = np.repeat(np.arange(len(data), dtype=np.int64), sizes + 1)
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        ranks = self._ranked(symbols[both], symbols[both + 1])
        index = [(ranks[ranks >= 0], both[ranks >= 0])]  # pieces of (rank, position) that wait for their block
        for end in self.steps:
            if not sum(len(x) for x, _ in index):
                break
            rank, place = (np.concatenate(x) for x in zip(*index, strict=True))
            now = rank < end
            index = [(rank[~now], place[~now])]
            rank, place = rank[now], place[now]
            while len(place):
                follow = after[place]
                live = (symbols[place] == self.left[rank]) & (symbols[follow] == self.right[rank])
                rank, place = rank[live], place[live]
                if not len(place):
                    break
                order = np.lexsort((place, rank, owner[place]))
                rank, place = rank[order], place[order]
                fresh = np.concatenate(([True], place[1:] != place[:-1]))
                rank, place = rank[fresh], place[fresh]
                word = owner[place]
                starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                lowest = rank == np.repeat(rank[starts], np.diff(np.concatenate((starts, [len(word)]))))
                rest = rank[~lowest], place[~lowest]
                rank, place = rank[lowest], place[lowest]
                # Of positions that overlap, as in a run of one symbol, every second one merges, from the left.
                chained = np.concatenate(([False], after[place[:-1]] == place[1:]))
                run = np.arange(len(place)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(place))))
                rank, place = rank[run % 2 == 0], place[run % 2 == 0]
                follow = after[place]
                behind = after[follow]
                symbols[place], symbols[follow] = self.merged[rank], -2  # -2: merged away
                after[place], before[behind] = behind, place
                ahead = before[place]
                ahead, right = ahead[(ahead >= 0) & (symbols[ahead] >= 0)], place[symbols[behind] >= 0]
                touched = np.concatenate((ahead, right))
                found = self._ranked(symbols[touched], symbols[after[touched]])
                soon = (found >= 0) & (found < end)
                late = found >= end
                index.append((found[late], touched[late]))
                rank, place = np.concatenate((rest[0], found[soon])), np.concatenate((rest[1], touched[soon]))
        alive = symbols >= 0
        cuts = np.concatenate(([0], np.cumsum(np.bincount(owner[alive], minlength=len(data))) * 4)).tolist()
        ids = symbols[alive].astype("<u4").tobytes()
        self.seen.update(zip(words, (ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), strict=True))

    def _split(self, text: str) -> list[str]:
        return self.ascii_words.findall(text) if text.isascii() else self.words.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.seen) > MEMORY:
            self.seen.clear()
        cut: list[list[str]] = []
        new: set[str] = set()
        for text in texts:
            if self.cut and any(x in text for x in self.special):
                parts: list[str] = []
                for piece in self.cut.split(text):
                    parts += [piece] if piece in self.special else self._split(piece)
            else:
                parts = self._split(text)
            cut.append(parts)
            new.update(parts)
        new.difference_update(self.special)
        new.difference_update(self.seen)
        if new:
            self.learn(list(new))
        for piece, i in self.special.items():
            self.seen[piece] = np.array([i], "<u4").tobytes()
        ids = self.seen.__getitem__
        return [b"".join(map(ids, parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.offsets[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[places].tobytes().decode("utf-8", "replace")


def _portions(sizes: list[int]) -> Iterator[slice]:
    """Cuts rows into runs of at most ``CHARS`` bytes; a longer text is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHARS:
            yield slice(start, i)
            start = i
            total = 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _content(path: str) -> str:
    if os.path.getsize(path) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


_ENCODERS: dict[int, PairIndexEncoder] = {}


def _encoder(broadcast) -> PairIndexEncoder:
    """One for each worker process and file."""
    key = hash(broadcast.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PairIndexEncoder(broadcast.value)
    return _ENCODERS[key]


def _encoded(docs: DataFrame, path: str | None, read_back: bool) -> DataFrame:
    content = docs.sparkSession.sparkContext.broadcast(_content(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            texts = batch.column("text")
            for part in _portions(pc.binary_length(texts).fill_null(0).to_pylist()):
                ids = encoder.encode_batch([x or "" for x in texts[part].to_pylist()])
                columns = [batch.column("doc_id")[part], pa.array(ids, pa.binary())]
                if read_back:
                    columns.append(pa.array(map(encoder.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    schema = "doc_id bigint, ids binary" + ", text string" * read_back
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each row; no shuffle."""
    return _encoded(docs, path, False)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What ``decode`` of ``encode`` gives, doc_id, ids and the text that the ids stand for, in one pass and one worker a task."""
    return _encoded(docs, path, True)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the text that they stand for; no shuffle."""
    content = encoded.sparkSession.sparkContext.broadcast(_content(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            texts = [encoder.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, text string")
