"""Secret scans over an incremental blob ledger.

Texts are content-addressed: a blob is known by the SHA-256 of its UTF-8 bytes, and every version of every path (here a
doc_id) refers to one. The ledger is a pair of written tables, ``scanned`` (blob, rule_version) and ``findings`` (blob,
rule_version, spans). A scan reads each blob that the ledger lacks for the current rule version once, whatever number of
paths and versions hold it, appends to the ledger, and joins findings back to all paths.

Only ids and digests are shuffled to find the unseen blobs (aggregated before the shuffle, so a blob that a third of all
paths share costs one row a task); texts travel once, compressed, to meet the blob that they stand for. A task that is lost
is computed again from the input; the ledger grows only by whole written parts, and a row is a whole blob's findings.

Rules: ``BASE`` kinds are found leftmost and without overlap, each kind on its own; matches whose secret is too short are
dropped afterwards. ``EXTRA`` kinds are this operator's own and only add spans. Offsets are code points, ends exclusive.

Defined results: a null text is an empty blob without findings; repeated rows give a row each; a null path is kept; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, whole_text

#: kind, pattern, the group that holds the secret, its least length. ASCII matching: letters in either case are listed by (?i) with re.ASCII.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
EXTRA = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", re.ASCII), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", re.ASCII), 0, 1),
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}", re.ASCII), 0, 1),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII), 0, 1),
    ("cloud", re.compile(r"AIza[A-Za-z0-9_-]{35}", re.ASCII), 0, 1),
    ("login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@", re.ASCII), 0, 1),
)
#: A literal that every match of the kind holds; texts without it are not searched for the kind.
NEEDLES = {"access": "AKIA", "pem": "-----BEGIN", "jwt": "eyJ", "forge": "gh", "chat": "xox", "cloud": "AIza", "login": "://"}
_ASSIGN_HINT = re.compile(r"(?:passw|secret|token|api_?key)", re.ASCII | re.IGNORECASE)
_HEX_HINT = re.compile(r"[0-9a-f]{32}")
RULE_VERSION = "2025-1-" + hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, p, g, n in BASE + EXTRA]).encode()).hexdigest()[:12]
ORDER = {kind: i for i, (kind, *_) in enumerate(BASE + EXTRA)}
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = "blob string, rule_version string, spans " + SPANS


def find_spans(text: str, rules=BASE + EXTRA) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start, then by kind as listed."""
    found = []
    for kind, pattern, group, least in rules:
        if kind == "assign" and not _ASSIGN_HINT.search(text) or kind == "hex" and not _HEX_HINT.search(text) or kind in NEEDLES and NEEDLES[kind] not in text:
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def _versions(docs: DataFrame, path: str) -> DataFrame:
    return docs.select(F.col(path).alias("path"), F.sha2(whole_text(), 256).alias("blob"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, text -> path, blob and the compressed text: texts are shuffled in this form."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([squeeze.compress(x) for x in raw], pa.binary())], names=["path", "blob", "packed"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """blob, packed -> blob, rule_version, spans."""
    expand = zstandard.ZstdDecompressor()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(expand.decompress(x).decode())] for x in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([RULE_VERSION] * len(spans), pa.string()), pa.array(spans, kind)], names=["blob", "rule_version", "spans"])


class Ledger:
    """What was scanned by which rules, kept under ``root`` in parts that are written whole."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch(spark, "secret-ledger")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{self.root}/findings")
        except AnalysisException:  # nothing was scanned yet
            return self.spark.createDataFrame([], LEDGER)

    def scan(self, docs: DataFrame, path: str = "doc_id") -> int:
        """Scans the blobs of ``docs`` that this ledger lacks for RULE_VERSION; returns how many."""
        known = self.rows().where(F.col("rule_version") == RULE_VERSION).select("blob")
        unseen = _versions(docs, path).groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left_anti")
        packed = docs.select(F.col(path).alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(_pack, _packed_schema(docs, path))
        left, right = packed.alias("l"), unseen.alias("r")
        chosen = left.join(right, F.col("l.blob").eqNullSafe(F.col("r.blob")) & F.col("l.path").eqNullSafe(F.col("r.path"))).select("l.blob", "l.packed")
        part = f"{self.root}/findings/{scratch(self.spark, 'part').rsplit('/', 1)[1]}"
        chosen.mapInArrow(_scan, LEDGER).write.parquet(part)
        return self.spark.read.schema(LEDGER).parquet(part).select("blob").distinct().count()

    def findings(self) -> DataFrame:
        """One row for each blob: (blob, spans) under RULE_VERSION. A blob may stand in several equal rows after a retry."""
        rows = self.rows().where(F.col("rule_version") == RULE_VERSION)
        return rows.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))


def _packed_schema(docs: DataFrame, path: str) -> str:
    return f"path {dict(docs.dtypes)[path]}, blob string, packed binary"


def secret_findings(docs: DataFrame, ledger: Ledger, path: str = "doc_id") -> DataFrame:
    """path, blob, spans for every row of ``docs``, after scanning what the ledger lacks."""
    ledger.scan(docs, path)
    empty = F.array().cast(SPANS)
    out = _versions(docs, path).join(ledger.findings(), "blob", "left")
    return out.select("path", "blob", F.coalesce("spans", empty).alias("spans"))


__all__ = ["BASE", "EXTRA", "RULE_VERSION", "Ledger", "find_spans", "secret_findings"]
