"""Line dedup by a sharded minimal perfect hash over all distinct line hashes.

A line's key is the line without white space at both ends, ASCII letters lower-cased; keys under ``LEAST`` code points are
left alone. A key that two or more documents hold loses all its lines except in the document of smallest id.

1. Every document gives each of its keys once, as a 128-bit hash with its id (a written table of 32 bytes a row).
2. Rows are aggregated by hash, map side first: the smallest id, and in how many documents the line is.
3. All distinct hashes are dealt into shards of about ``SHARD`` keys. A shard is a minimal perfect hash (levels of bit arrays, as
   in the published BBHash scheme) and, in its order, arrays of 64-bit fingerprints, one-byte document counts (``MOST`` stands
   for that many and more) and keeping ids.
4. Documents probe the arrays: hashes meet their shard, salted so that a group holds about ``SHARD`` rows however often one line
   occurs; each probe is one position, one fingerprint comparison, one look at the count and, where it is 2 or more, at the keeping
   id. No line is joined.
5. Only lines to drop go back to their documents.

A hash outside the set lands on some position and is rejected by its fingerprint; position and fingerprint together are all
128 bits of the hash.

Defined results: a null or empty text is one empty line and stays as it is; rows with the same doc_id are one document, so
all of them keep or lose a line; a null doc_id counts as one document, after all others (its rows are still dealt and met one by
one, by a hash of id and text); texts whose lines all go become empty; an empty table gives no rows; other columns pass through
untouched, whatever their names, but for those that ``dedup_lines`` is asked to write.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import columns_of, stored, unused

LEAST = 10
SHARD = 1 << 18
GAMMA, LEVELS = 2.0, 40
MOST = 255
#: Hashes that a task sends at once.
SEND = 1 << 16
LAST_ID = (1 << 63) - 1
_WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str) -> list[bytes]:
    """The key of every line; b"" where the key is too short to count."""
    out = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip(_WHITE)
        out.append(key if len(key) >= 4 * LEAST or len(key) >= LEAST and len(key.decode()) >= LEAST else b"")
    return out


def hash_key(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD6E8FEB86659FD93) & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash over distinct pairs of 64-bit numbers: 0 to n - 1 for members, anything or -1 for others."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one bool array each
        self.ranks = []
        total = 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - 1 + total
            total += int(bits.sum())
            self.ranks.append(ranks)
        self.size = total

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            if len(levels) == LEVELS:
                raise ValueError("keys repeat")
            size = max(64, int(GAMMA * len(a)))
            at = (_mix(a, b, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (_mix(a[open_], b[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, sizes: list[int], data: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            m = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, m, at), count=n).astype(bool))
            at += m
        return cls(levels)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, row, text -> h1, h2, id, row: each key of a row once."""
    hashes: list[bytes] = []
    owners: list[tuple[int, int, int]] = []  # id, row, how many hashes

    def packed() -> pa.RecordBatch:
        both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        ids, rows, counts = np.array(owners, np.int64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids, counts)), pa.array(np.repeat(rows, counts))], names=["h1", "h2", "id", "row"])

    for batch in batches:
        for id_, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if not (text := text.as_py()):
                continue
            keys = dict.fromkeys(line_keys(text))
            keys.pop(b"", None)
            hashes += map(hash_key, keys)
            owners.append((id_, row, len(keys)))
            if len(hashes) >= SEND:
                yield packed()
                hashes.clear()
                owners.clear()
    if hashes:
        yield packed()


def _identity(docs: DataFrame) -> tuple[Column, Column]:
    """The id of a row's document, and a hash that tells apart rows of one id whose texts differ."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h1, h2, id, row): every key of every document."""
    id_, row = _identity(docs)
    rows = docs.select(id_.alias("id"), row.alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_emit, "h1 bigint, h2 bigint, id bigint, row bigint")


def _as_u64(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


INDEX = "shard bigint, sizes array<bigint>, bits binary, fingerprints binary, counts binary, keepers binary"


def _build_shard(keys: pa.Table) -> pa.Table:
    a, b = _as_u64(keys["h1"]), _as_u64(keys["h2"])
    index = PerfectHash.build(a, b)
    at = index.find(a, b)
    fingerprints, counts, keepers = np.empty(len(a), np.uint64), np.empty(len(a), np.uint8), np.empty(len(a), np.int64)
    fingerprints[at] = b
    counts[at] = np.minimum(keys["n"].to_numpy(), MOST)
    keepers[at] = keys["keeper"].to_numpy()
    sizes, bits = index.pack()
    return pa.table({"shard": keys["shard"][:1].combine_chunks(), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "keepers": pa.array([keepers.tobytes()], pa.binary())})


def build_index(hashes: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index over all distinct hashes of ``hashes``, one row a shard, and the number of shards."""
    ids = hashes.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    # Rows of one id are one document: a line that only they hold is in one.
    distinct = stored(ids.select("h1", "h2", "keeper", F.when(F.col("keeper") < F.col("last"), F.col("n")).otherwise(F.lit(1)).alias("n")), "distinct-lines")
    shards = max(1, -(-distinct.count() // shard))
    rows = distinct.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))
    return stored(rows.groupBy("shard").applyInArrow(_build_shard, INDEX), "line-index"), shards


def _probe(rows: pa.Table, index: pa.Table) -> pa.Table:
    out = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    if not rows.num_rows or not index.num_rows:
        return out.empty_table()
    one = index.slice(0, 1).to_pylist()[0]
    perfect = PerfectHash.unpack(one["sizes"], one["bits"])
    fingerprints, counts, keepers = (np.frombuffer(one[c], kind) for c, kind in (("fingerprints", np.uint64), ("counts", np.uint8), ("keepers", np.int64)))
    a, b = _as_u64(rows["h1"]), _as_u64(rows["h2"])
    at = perfect.find(a, b)
    safe = np.maximum(at, 0)
    drop = (at >= 0) & (fingerprints[safe] == b) & (counts[safe] >= 2) & (keepers[safe] != rows["id"].to_numpy())
    return rows.select(["id", "row", "h1", "h2"]).filter(pa.array(drop)).cast(out)


def dropped_lines(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(id, row, drops): for each document that loses lines, the hashes of their keys."""
    hashes = stored(line_hashes(docs), "line-hashes")
    index, shards = build_index(hashes, shard)
    rows = hashes.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))
    salts = stored(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).alias("salts")), "line-salts").withColumnRenamed("shard", "s")
    probes = rows.join(salts, F.col("shard") == F.col("s")).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).select("shard", "salt", "id", "row", "h1", "h2")
    copies = index.join(salts, F.col("shard") == F.col("s")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("s", "salts")
    found = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe, "id bigint, row bigint, h1 bigint, h2 bigint")
    return found.groupBy("id", "row").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def _rewriter(drops: str, added: tuple[str, str]):
    """Drops lines from text; the column ``drops`` gives way to the numbers of lines before and of those dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            place = names.index("text")
            texts, lines, gone = [], [], []
            for text, found in zip(batch.column(place), batch.column(names.index(drops)), strict=True):
                text, found = text.as_py(), found.as_py()
                n = (text or "").count("\n") + 1
                dropped = 0
                if found:
                    bad = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in found}
                    kept = [line for line, key in zip(text.split("\n"), line_keys(text), strict=True) if not key or hash_key(key) not in bad]
                    dropped, text = n - len(kept), "\n".join(kept)
                texts.append(text)
                lines.append(n)
                gone.append(dropped)
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i, name in enumerate(names) if name != drops]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*(x for x in names if x != drops), *added])

    return run


def dedup_lines(docs: DataFrame, shard: int = SHARD, names: tuple[str, str] = ("__n_lines", "__n_dropped")) -> DataFrame:
    """``docs`` with shared lines gone from ``text``, and two columns ``names``: the number of lines before, and of those dropped.
    Columns of the input with these names give way."""
    docs = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    id_, row = _identity(docs)
    drop_id, drop_row, drops = unused(docs.columns, "__drop_id", "__drop_row", "__drops")
    found = dropped_lines(docs, shard).withColumnsRenamed({"id": drop_id, "row": drop_row, "drops": drops})
    met = docs.join(found, (id_ == F.col(drop_id)) & (row == F.col(drop_row)), "left").select(*columns_of(docs), drops)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names)])
    return met.mapInArrow(_rewriter(drops, names), schema)


def without_shared_lines(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``docs`` with shared lines gone, with its own columns; n_chars, where there is such a column, follows the text."""
    names = tuple(unused(docs.columns, "__n_lines", "__n_dropped"))
    out = dedup_lines(docs, shard, names)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*columns_of(docs))
