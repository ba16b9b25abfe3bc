"""Similarity self-join of word n-gram sets under Jaccard, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds the hashed n-grams of its words. Documents with equal sets are one node. Two nodes link when
``den * |A and B| >= num * |A or B|``; the operator returns the classes that links make.

* A set of n tokens can miss at most d = n - ceil(num * n / den) tokens of any partner. Small sets (n up to the boundary)
  enumerate all their subsets of n - d to n tokens; two small sets that link share one, namely what they have in common. A subset
  of k tokens tells of no pair that needs more than k in common, so most entries go before any pair is looked at.
* Large sets put their first d + 1 tokens, rarest first, into inverted lists. Two sets that link share one of these. Small
  sets near the boundary join the lists too, so no pair across the boundary is lost.
* The boundary is the size at which the summed cost is least: one for each subset that is enumerated below it, and for each list
  entry above it (and of sets near it, which pay both) the entries that its scan can meet, as the sketch below counts them. Of
  equal costs the larger boundary is taken. It is sought among sizes with at most ``MOST_SUBSETS`` subsets; any boundary gives the
  same result.
* "Rarest first" is one order of all tokens: by their count in a sketch of ``1 << SKETCH_BITS`` counters over all sets, then
  by value. The sketch has a fixed size, so it can be broadcast; collisions change only how long lists are, never a result.

Lists are not expanded into pairs within a class. First every member of a list is compared with the list's leader (the
member for which the shared token comes earliest), which needs one pair a list entry; what links is contracted into classes.
Then only members of one list that are in different classes are compared. Both comparisons first apply the length and
position bounds and end in an exact check on whole sets. Two members of one class need no comparison, so every class is whole.

A list that a token of more than one set in ``PARTS`` can make is dealt into sub-lists, as the sketch tells, so that none holds
more than about one set in ``PARTS``. Each has a leader, leaders are compared with the first of them, and what is still in
different classes is compared by pairs of sub-lists, each a task's work of its own.

Defined results: lower-casing and words as in the docstring of ``shingles``; a document with fewer words than an n-gram is
one token; one without words or text has the empty set, links with nothing and is its own class; rows with a null doc_id
link as others do and never name a class unless it has null ids only; rows that repeat a doc_id are nodes by their own
texts; an empty table gives no rows; other columns, whatever their names, pass through ``keep_representatives`` untouched. Equality
of tokens is equality of 64-bit hashes, equality of sets that of 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import columns_of, stored, unused
from tidemark.llm.components import components

SKETCH_BITS = 20
BLOCKS = 64
#: The boundary is sought among sizes with at most so many subsets; this bounds what one small set enumerates.
MOST_SUBSETS = 1200
#: A list is dealt into sub-lists if its token may be in more than one set of so many, and in ``LONG`` sets at least.
PARTS = 256
LONG = 4096
_P = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """n-gram width, and the least similarity num / den."""

    width: int = 5
    num: int = 80
    den: int = 100

    def need(self, n: int) -> int:
        """The least overlap of a set of n tokens with any partner, and the least size of one."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """The least overlap of partners with n and m tokens; arrays do too."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def subsets(self, n: int) -> int:
        return sum(comb(n, k) for k in range(n - self.need(n) + 1))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a text that are hashed at once; cut at white space.
CHUNK = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """The powers of _P and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for which, base in enumerate((_P, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over its bytes, from running sums over the text, then mixed."""
    out = []
    while text:
        cut = len(text)
        if cut > CHUNK:
            cut = next((i for i in range(CHUNK, cut) if text[i] in b" \t\n\x0b\x0c\r"), cut)
        data, text = np.frombuffer(text[:cut], np.uint8), text[cut:]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SPACES[data], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        powers, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers[:n], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
    return np.concatenate(out) if len(out) != 1 else out[0]


def shingles(text: str | bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-grams of a text's words (split at ASCII white space, A-Z lower-cased)."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    h = word_hashes(raw) if raw else np.zeros(0, np.uint64)
    n = len(h)
    if not n:
        return h
    short = min(width, n)
    x = h[: n - short + 1].copy()
    for k in range(1, short):
        x *= _P
        x += h[k : n - short + 1 + k]
    if n < width:
        x = x * _P + np.uint64(n)
    x = mix(x)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _sets(width: int, keep: bool):
    """doc_id, text -> doc_id, n, s1, s2 and, if kept, the compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes, marks, packed = [], [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                tokens = shingles(raw, width)
                sizes.append(len(tokens))
                marks.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                if keep:
                    packed.append(squeeze.compress(raw) if len(tokens) else b"")
            both = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            names = ["doc_id", "n", "s1", "s2"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())] if keep else columns, names=[*names, "packed"] if keep else names)

    return run


def set_marks(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (set size) and the set's 128-bit mark s1, s2 of every row."""
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_sets(rule.width, False), "doc_id bigint, n int, s1 bigint, s2 bigint")


def marked(docs: DataFrame, rule: Rule, names: list[str]) -> DataFrame:
    """Every row of ``docs`` with its set's size and mark in three more columns ``names``."""
    width, text = rule.width, docs.columns.index("text")
    n, s1, s2 = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), width) for x in batch.column(text).cast(pa.string())]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), "<i8").reshape(-1, 2)
            more = [pa.array([len(x) for x in found], pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, n, s1, s2])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(n, T.IntegerType()), T.StructField(s1, T.LongType()), T.StructField(s2, T.LongType())]))


def distinct_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row for each non-empty set: node, s1, s2, n, doc_id (the smallest) and one of its texts, compressed. A written table."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_sets(rule.width, True), "doc_id bigint, n int, s1 bigint, s2 bigint, packed binary")
    one = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("packed").alias("packed"))
    return stored(one.withColumn("node", F.monotonically_increasing_id()), "sets")


def _unpacked(batches: Iterator[pa.RecordBatch], width: int, size: int = 512):
    """Slices of batches with the token sets of their rows."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, [shingles(expand.decompress(x), width) for x in part.column("packed").to_pylist()]


def token_sketch(sets: DataFrame, rule: Rule, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many sets hold a token of each of 1 << bits classes. Tasks send compressed blocks of counters; blocks are added
    one by one, and the sum has a fixed size."""
    width, block = rule.width, (1 << bits) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, np.int64)
        for _, found in _unpacked(batches, width):
            out += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        squeeze = zstandard.ZstdCompressor(level=1)
        kind = np.uint8 if out.max() < 256 else np.uint16 if out.max() < 65536 else np.int64
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([np.dtype(kind).itemsize] * BLOCKS, pa.int32()), pa.array([squeeze.compress(x.tobytes()) for x in out.astype(kind).reshape(BLOCKS, block)], pa.binary())], names=["block", "width", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for at, size, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "width", "counts")), strict=True):
                kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[size]
                sums.setdefault(at, np.zeros(block, np.int64))
                sums[at] += np.frombuffer(expand.decompress(counts), kind)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    parts = sets.select("packed").mapInArrow(count, "block int, width int, counts binary")
    total = np.zeros((BLOCKS, block), np.int64)
    for row in parts.repartition(BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect():  # BLOCKS rows, 8 << bits bytes
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(total.ravel(), (1 << 32) - 1).astype(np.uint32)


def _first_tokens(tokens: np.ndarray, sketch: np.ndarray, n: int) -> np.ndarray:
    """The first n tokens in the order of all tokens: by sketch count, then by value."""
    counts = sketch[(tokens >> np.uint64(64 - (len(sketch).bit_length() - 1))).astype(np.int64)]
    return tokens[np.argsort(counts.astype(np.uint64) << np.uint64(32) | tokens >> np.uint64(32), kind="stable")[:n]]


def sizes_and_costs(sets: DataFrame, rule: Rule, sketch) -> dict[int, tuple[int, int]]:
    """Of every size up to the largest with ``MOST_SUBSETS`` subsets: how many sets have it, and what scanning their lists costs."""
    limit = 0
    while rule.subsets(limit + 1) <= MOST_SUBSETS:
        limit += 1
    width = rule.width

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, scans = np.zeros(limit + 1, np.int64), np.zeros(limit + 1, np.int64)
        counts = sketch.value
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        for _, found in _unpacked(batches, width):
            for tokens in found:
                n = len(tokens)
                first = _first_tokens(tokens, counts, n - rule.need(n) + 1)
                number[n] += 1
                scans[n] += counts[(first >> shift).astype(np.int64)].sum(dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(limit + 1), pa.int32()), pa.array(number), pa.array(scans)], names=["n", "number", "scans"])

    rows = sets.where(F.col("n") <= limit).select("packed").mapInArrow(cost, "n int, number bigint, scans bigint").groupBy("n").agg(F.sum("number").alias("number"), F.sum("scans").alias("scans")).collect()
    return {n: (0, 0) for n in range(limit + 1)} | {r["n"]: (r["number"], r["scans"]) for r in rows}  # at most ``limit`` rows


def boundary(costs: dict[int, tuple[int, int]], rule: Rule) -> int:
    """The largest size whose sets enumerate subsets: where enumeration and list scans together cost least."""
    total = lambda x: sum(number * rule.subsets(n) if n <= x else 0 for n, (number, _) in costs.items()) + sum(scans if n >= rule.need(x + 1) else 0 for n, (_, scans) in costs.items())
    return min(costs, key=lambda x: (total(x), -x))


def postings(sets: DataFrame, rule: Rule, sketch, small: int, nodes: int, parts: int = PARTS, long: int = LONG) -> DataFrame:
    """(key, node, n, pos, salt, salts): subset keys of small sets (pos is -k for a subset of k tokens), list keys of large ones and
    of those that they can link with. A list that may be long has ``salts`` sub-lists."""
    width, least = rule.width, rule.need(small + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        for part, found in _unpacked(batches, width):
            keys, places, lengths, salts = [], [], [], []
            for tokens in found:
                n, own = len(tokens), 0
                if n <= small:
                    each = mix(tokens * _P + np.uint64(1)).tolist()
                    whole = sum(each)
                    sums = [(n - k, (whole - sum(gone)) & 0xFFFFFFFFFFFFFFFF) for k in range(n - rule.need(n) + 1) for gone in combinations(each, k)]
                    sized = np.array([s for s, _ in sums], np.uint64)
                    keys.append(mix(np.array([x for _, x in sums], np.uint64) ^ mix(sized + _P)))
                    places.append(-sized.astype(np.int32))
                    salts.append(np.ones(len(sums), np.int64))
                    own += len(sums)
                if n >= least:
                    first = _first_tokens(tokens, counts, n - rule.need(n) + 1)
                    keys.append(first)
                    places.append(np.arange(len(first), dtype=np.int32))
                    length = counts[(first >> shift).astype(np.int64)].astype(np.int64)
                    salts.append(np.where(length < long, 1, np.clip(length * parts // max(1, nodes), 1, parts)))
                    own += len(first)
                lengths.append(own)
            if keys:
                owners = np.repeat(part.column("node").to_numpy(), lengths)
                sizes = np.repeat(np.fromiter(map(len, found), np.int32, len(found)), lengths)
                dealt = np.concatenate(salts)
                salt = (mix(owners.view(np.uint64)) % dealt.view(np.uint64)).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys).view(np.int64), owners, sizes, np.concatenate(places), salt, dealt.astype(np.int16))], names=["key", "node", "n", "pos", "salt", "salts"])

    return sets.select("node", "packed").mapInArrow(run, "key bigint, node bigint, n int, pos int, salt smallint, salts smallint")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], by: str = "key") -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of equal ``by`` from batches in which equal ones stand together, many runs at a time."""
    held: list[dict[str, np.ndarray]] = []  # pieces of the run that may go on
    joined = lambda pieces: {c: np.concatenate([x[c] for x in pieces]) for c in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        key = now[by]
        turns = np.flatnonzero(key[1:] != key[:-1])
        last = int(turns[-1]) + 1 if len(turns) else 0  # where the last run starts
        if last:
            yield joined([*held, {c: x[:last] for c, x in now.items()}])
            held = [{c: x[last:] for c, x in now.items()}]
        elif held and held[0][by][0] == key[0]:
            held.append(now)
        else:
            if held:
                yield joined(held)
            held = [now]
    if held:
        yield joined(held)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(key)])))


def _possible(rule: Rule, n, m, i, j):
    """Whether partners of n and m tokens need be compared for a common token that stands at i and j: it must lie in the first
    n - o + 1 and m - o + 1 tokens, of which partners with an overlap of o share one, and leave room for that overlap. Or for a
    common subset of -i = -j tokens, which has to be as large as that overlap."""
    need = rule.overlap(n, m)
    early = (i <= n - need) & (j <= m - need)
    room = np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1) >= need
    return ((i < 0) & (i == j) & (-i >= need) | early & room & (i >= 0) & (j >= 0)) & (np.minimum(n, m) >= -(-rule.num * np.maximum(n, m) // rule.den))


def _useful(rule: Rule, key: np.ndarray, n: np.ndarray, pos: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Which entries can pair at all: not those alone in their list, and of a subset's only those whose size allows for the
    smallest other set's, or that are the smallest and allow for some other."""
    starts, lengths = _runs(key)
    subset, size = pos < 0, n.astype(np.int64)
    # Entries stand in order of size, so a run's first two have its two smallest sizes.
    least = np.repeat(size[starts], lengths)
    second = np.repeat(size[np.minimum(starts + 1, len(key) - 1)], lengths)
    place = np.arange(len(key)) - np.repeat(starts, lengths)
    partner = np.where(place == 0, second, least)
    fits = ~subset | (-pos.astype(np.int64) >= rule.overlap(size, partner))
    return fits & ((np.repeat(lengths, lengths) > 1) | (salts > 1))


LISTS = "list bigint, key bigint, node bigint, n int, pos int, salt smallint, salts smallint, leader bigint, possible boolean"


def shared_lists(posted: DataFrame, rule: Rule) -> DataFrame:
    """Entries of lists that can hold a pair, each with its (sub-)list's leader. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["list", "key", "pos", "node", "n", "salt", "salts"], "list"):
            keep = _useful(rule, g["list"], g["n"], g["pos"], g["salts"])
            g = {c: x[keep] for c, x in g.items()}
            starts, lengths = _runs(g["list"])
            first = np.repeat(starts, lengths) if len(g["list"]) else starts[:0]
            n, pos = g["n"].astype(np.int64), g["pos"].astype(np.int64)
            possible = _possible(rule, n, n[first], pos, pos[first]) & (g["node"] != g["node"][first])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(g[c] for c in ("list", "key", "node", "n", "pos", "salt", "salts")), g["node"][first], possible)], names=["list", "key", "node", "n", "pos", "salt", "salts", "leader", "possible"])

    dealt = posted.withColumn("list", F.when(F.col("salts") == 1, F.col("key")).otherwise(F.xxhash64("key", "salt")))
    ordered = dealt.repartition("list").sortWithinPartitions("list", "pos", "n", "node")
    return stored(ordered.select("list", "key", "node", "n", "pos", "salt", "salts").mapInArrow(run, LISTS), "lists")


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): members of lists with their leaders, and leaders of sub-lists with the first leader of their list."""
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    members = lists.where("possible").select(*pair("leader", "node"))
    heads = lists.where("salts > 1 AND node = leader").select("key", "node")
    tops = heads.groupBy("key").agg(F.min("node").alias("top")).withColumnRenamed("key", "tk")
    between = heads.join(tops, F.col("key") == F.col("tk")).where("node <> top").select(*pair("top", "node"))
    return members.unionByName(between).distinct()


def _pairs_apart(rule: Rule, g: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lists sorted by size whose members are in different classes, by their distance in the list, all lists at once.
    A member leaves when its list ends or the other's size is out of reach, as all further ones are. Where two sub-lists meet,
    only members of both are paired."""
    key, node, comp, salt, meet = g["list"], g["node"], g["comp"], g["salt"], g["meet"]
    n, pos = g["n"].astype(np.int64), g["pos"].astype(np.int64)
    starts, lengths = _runs(key)
    apart = np.concatenate(([False], (comp[1:] != comp[:-1]) & (key[1:] == key[:-1])))
    left = np.flatnonzero(np.repeat(np.add.reduceat(apart, starts, dtype=np.int64) > 0, lengths))
    far = 0
    while len(left):
        far += 1
        left = left[left + far < len(key)]
        right = left + far
        near = (key[right] == key[left]) & (n[left] >= -(-rule.num * n[right] // rule.den))
        left, right = left[near], right[near]
        ok = (comp[left] != comp[right]) & (~meet[left] | (salt[left] != salt[right])) & _possible(rule, n[left], n[right], pos[left], pos[right])
        if ok.any():
            a, b = node[left[ok]], node[right[ok]]
            yield np.minimum(a, b), np.maximum(a, b)


def cross_pairs(lists: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): pairs that share a list, in different classes, and can reach the least overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["list", "n", "node", "pos", "comp", "salt", "meet"], "list"):
            for a, b in _pairs_apart(rule, g):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    met = lists.join(classes.select(F.col("node").alias("cn"), "component"), F.col("node") == F.col("cn"), "left")
    rows = met.select("list", "key", "node", "n", "pos", "salt", "salts", F.coalesce("component", "node").alias("comp"))
    whole = rows.where("salts = 1").select("list", "node", "n", "pos", "comp", "salt", F.lit(False).alias("meet"))
    # Of dealt lists, those with one class only are done; an entry of others goes to every pair that its sub-list is in.
    long = rows.where("salts > 1")
    open_ = long.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select(F.col("key").alias("ok"))
    other = long.join(open_, F.col("key") == F.col("ok"), "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)))
    dealt = other.select(F.xxhash64("key", F.least("salt", "other"), F.greatest("salt", "other")).alias("list"), "node", "n", "pos", "comp", "salt", (F.col("salt") != F.col("other")).alias("meet"))
    return whole.unionByName(dealt).repartition("list").sortWithinPartitions("list", "n", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link, by an exact check of whole sets. A written table."""
    width = rule.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        last, left = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for i, (pa_, pb) in enumerate(zip(batch.column("packed_a"), batch.column("packed_b"), strict=True)):
                if a[i] != last:
                    last, left = a[i], shingles(expand.decompress(pa_.as_py()), width)
                right = shingles(expand.decompress(pb.as_py()), width)
                common = len(left) + len(right) - len(np.union1d(left, right))
                ok.append(common >= rule.overlap(len(left), len(right)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = sets.select("node", "packed")
    met = pairs.join(texts.select(F.col("node").alias("nb"), F.col("packed").alias("packed_b")), F.col("b") == F.col("nb"))
    met = met.join(texts.select(F.col("node").alias("na"), F.col("packed").alias("packed_a")), F.col("a") == F.col("na"))
    return stored(met.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a bigint, b bigint"), "links")


def classes(docs: DataFrame, rule: Rule = Rule(), parts: int = PARTS, long: int = LONG) -> DataFrame:  # noqa: B008
    """(s1, s2, component_id, r1, r2) of every non-empty set: component_id is the smallest doc_id of its class, and r1, r2 marks the set
    that holds it (of several the smallest)."""
    sets = distinct_sets(docs, rule)
    context = docs.sparkSession.sparkContext
    sketch = context.broadcast(token_sketch(sets, rule))  # 4 << SKETCH_BITS bytes
    small = boundary(sizes_and_costs(sets, rule, sketch), rule)
    lists = shared_lists(postings(sets, rule, sketch, small, sets.count(), parts, long), rule)
    led = stored(leader_pairs(lists), "led")
    links = verified(led, sets, rule)
    known = stored(components(links), "classes")
    rest = stored(cross_pairs(lists, known, rule).join(led, ["a", "b"], "left_anti"), "cross")
    more = verified(rest, sets, rule)
    if not more.isEmpty():
        known = stored(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "classes")
    named = sets.select("node", "s1", "s2", "doc_id").join(known.withColumnRenamed("node", "kn"), F.col("node") == F.col("kn"), "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "s1", "s2")).alias("least"))
    return stored(named.join(names, "component").select("s1", "s2", F.col("least.doc_id").alias("component_id"), F.col("least.s1").alias("r1"), F.col("least.s2").alias("r2")), "named")


def with_classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles and component_id of every row."""
    found = classes(docs, rule).select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "component_id")
    met = set_marks(docs, rule).join(found, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")), "left")
    return met.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that stand for their class, and those without words. A class is stood for by the row of its smallest
    doc_id, among texts that share this id by the one of the smallest mark; rows that repeat both stay together. A class whose ids
    are all null keeps one row."""
    n, s1, s2, t1, t2, keeper = unused(docs.columns, "__n", "__s1", "__s2", "__t1", "__t2", "__keeper")
    stand = classes(docs, rule).where("s1 = r1 AND s2 = r2").select(F.col("s1").alias(t1), F.col("s2").alias(t2), F.col("component_id").alias(keeper))
    own = columns_of(docs)
    id_ = F.col("doc_id").cast("bigint")
    same = (F.col(s1) == F.col(t1)) & (F.col(s2) == F.col(t2))
    rows = marked(docs.where(id_.isNotNull()), rule, [n, s1, s2])
    kept = rows.join(stand.where(F.col(keeper).isNotNull()), same & (id_ == F.col(keeper)), "left").where((F.col(n) == 0) | F.col(keeper).isNotNull()).select(*own)
    # Rows without an id: they stand only for classes that have none.
    bare = marked(docs.where(id_.isNull()), rule, [n, s1, s2])
    empty = bare.where(F.col(n) == 0).select(*own)
    alone = bare.where(F.col(n) > 0).dropDuplicates([s1, s2]).join(stand.where(F.col(keeper).isNull()), same, "left_semi").select(*own)
    return kept.unionAll(empty).unionAll(alone)
