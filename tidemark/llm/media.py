"""Media columns: ISO base media containers built and walked without decoding payloads.

``read_container`` walks nested boxes (32-bit, 64-bit and to-the-end sizes), decodes each track's sample tables (stsd, stts,
ctts, stss, stsz or stz2, stsc, stco or co64, mdhd of both versions) and the runs of movie fragments (trex, tfhd, trun), and returns
codec, duration, frame count, composition offsets and the byte ranges of samples and keyframes of every track. It only reads headers:
payload bytes are touched when a caller slices the ranges.

``build_container`` writes payload bytes, a multiple of ``UNIT``, as the frames of an uncompressed ``raw `` video track of 8 by
8 pixels with three 8-bit samples each; every ``KEY_EVERY``-th frame is listed as a keyframe and a chunk holds
``CHUNK_FRAMES`` frames. The same payload always gives the same bytes: no times or ids are stored. Files whose media data
would pass 4 GiB get 64-bit boxes and offsets.

Defined results: a null or empty text is one unit of padding; a truncated or malformed container raises ValueError in
``read_container`` and gives null features with the message in ``error`` in ``media_features``, as one without tracks does; a track
without samples has no ranges, no keyframes and an empty payload; repeated rows give a row each, null ids stay null; an empty table
gives no rows; other columns are not read. The flat columns are those of the first track, ``tracks`` lists all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

UNIT, WIDTH, HEIGHT = 192, 8, 8
TIMESCALE, FRAME_TICKS = 25_000, 1_000
KEY_EVERY, CHUNK_FRAMES = 12, 25
#: Boxes that hold boxes. Fixed values of the format.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def payload_of(text: str | None) -> bytes:
    """UTF-8, padded with spaces to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _ints(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def build_container(payload: bytes, unit: int = UNIT) -> bytes:
    if not payload or len(payload) % unit:
        raise ValueError(f"a payload is a positive multiple of {unit} bytes")
    frames = len(payload) // unit
    ticks = frames * FRAME_TICKS
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if chunks > 1 else []
    if not runs or last != CHUNK_FRAMES:
        runs.append((chunks, last, 1))
    entry = _box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32xHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, 24, -1))
    start = _box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(start) + head
    offsets = at + np.arange(chunks, dtype=np.uint64) * (CHUNK_FRAMES * unit)
    wide = int(offsets[-1]) >= 1 << 32
    table = _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), _ints(offsets))
    keys = np.arange(1, frames + 1, KEY_EVERY)
    long = ticks >= 1 << 32
    form = ">QQIQ" if long else ">IIII"
    samples = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)),
        _full(b"stss", struct.pack(">I", len(keys)), _ints(keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), _ints(runs)),
        _full(b"stsz", struct.pack(">II", unit, frames)),
        table,
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(form, 0, 0, TIMESCALE, ticks), struct.pack(">HH", 0x55C4, 0), version=int(long)),
        _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), samples),
    )
    track = _full(b"tkhd", struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, ticks), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=int(long), flags=3)
    movie = _full(b"mvhd", struct.pack(form, 0, 0, TIMESCALE, ticks), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=int(long))
    data = _box(b"mdat", payload)
    return b"".join((start, data, _box(b"moov", movie, _box(b"trak", track, media))))


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    channels: int = 0
    timescale: int = 0
    duration: int = 0
    id: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)
    #: Of movie fragments, in order: start, end, ticks and composition offset of each sample, and whether it is a keyframe.
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _entries(self, name: bytes, form: str) -> np.ndarray:
        body = self.tables.get(name, bytes(8))
        n = struct.unpack_from(">I", body, 4)[0]
        kind = np.dtype(form)
        if len(body) < 8 + n * kind.itemsize:
            raise ValueError(f"{name.decode()} is cut off")
        return np.frombuffer(body, kind, n, 8)

    def sizes(self) -> np.ndarray:
        if b"stz2" in self.tables:
            body = self.tables[b"stz2"]
            bits, n = body[7], struct.unpack_from(">I", body, 8)[0]
            if bits == 4:
                pairs = np.frombuffer(body, np.uint8, (n + 1) // 2, 12)
                return np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n].astype(np.int64)
            return np.frombuffer(body, f">u{bits // 8}", n, 12).astype(np.int64)
        body = self.tables.get(b"stsz", bytes(12))
        size, n = struct.unpack_from(">II", body, 4)
        return np.full(n, size, np.int64) if size else np.frombuffer(body, ">u4", n, 12).astype(np.int64)

    def ranges(self) -> np.ndarray:
        """Start and end byte of every sample, in decoding order."""
        return np.concatenate([self._table_ranges(), *(np.stack(run[:2], 1) for run in self.runs)])

    def composition(self) -> np.ndarray:
        """How many ticks after its decoding time each sample is shown."""
        known = self.tables.get(b"ctts")
        runs = self._entries(b"ctts", ">u4,>i4" if known and known[0] else ">u4,>u4")
        first = np.repeat([int(r[1]) for r in runs] or np.zeros(0, np.int64), [int(r[0]) for r in runs] or np.zeros(0, np.int64)).astype(np.int64)
        n = len(self.sizes())
        return np.concatenate([first[:n], np.zeros(max(0, n - len(first)), np.int64), *(run[3] for run in self.runs)])

    def _table_ranges(self) -> np.ndarray:
        sizes = self.sizes()
        chunks = self._entries(b"co64", ">u8") if b"co64" in self.tables else self._entries(b"stco", ">u4")
        runs = self._entries(b"stsc", ">u4,>u4,>u4")
        firsts = [int(r[0]) for r in runs] + [len(chunks) + 1]
        per = np.concatenate([np.full(max(0, b - a), int(r[1]), np.int64) for a, b, r in zip(firsts, firsts[1:], runs, strict=False)] or [np.zeros(0, np.int64)])
        if per.sum() < len(sizes):
            raise ValueError("the chunks hold fewer samples than there are")
        of = np.repeat(np.arange(len(per)), per)[: len(sizes)]
        ends = np.cumsum(sizes)
        begin = ends - sizes
        lead = np.concatenate(([0], np.cumsum(per)[:-1])) if len(per) else np.zeros(0, np.int64)
        used = np.minimum(lead, max(len(sizes) - 1, 0)).astype(np.int64)
        start = chunks.astype(np.int64)[of] + begin - begin[used][of] if len(sizes) else np.zeros(0, np.int64)
        return np.stack((start, start + sizes), 1) if len(sizes) else np.zeros((0, 2), np.int64)

    def keyframes(self) -> np.ndarray:
        """Numbers of the sync samples, from 0; all of them where the track has no list."""
        out = [self._entries(b"stss", ">u4").astype(np.int64) - 1 if b"stss" in self.tables else np.arange(len(self.sizes()))]
        at = len(self.sizes())
        for start, *_, sync in self.runs:
            out.append(np.flatnonzero(sync) + at)
            at += len(start)
        return np.concatenate(out)

    def ticks(self) -> int:
        return int(sum(int(n) * int(d) for n, d in self._entries(b"stts", ">u4,>u4")) + sum(int(run[2].sum()) for run in self.runs)) or self.duration


def boxes(data, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes between start and end."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, start + head, start + size
        start += size
    if bytes(data[start:end]).strip(b"\0"):  # a list may end in zeros
        raise ValueError("a box header is cut off")


#: Bits of tfhd and trun that say which fields follow, and the sample flag of frames that need others. Fixed values of the format.
TFHD_BASE, TFHD_DESCRIPTION, TFHD_TICKS, TFHD_SIZE, TFHD_FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
TRUN_OFFSET, TRUN_FIRST_FLAGS, TRUN_TICKS, TRUN_SIZE, TRUN_FLAGS, TRUN_COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


@dataclass
class _Fragment:
    """One track's part of a movie fragment, as far as it was read."""

    track: Track
    base: int
    ticks: int
    size: int
    flags: int

    @classmethod
    def of(cls, body: bytes, movie: int, tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> _Fragment:
        bits, number = struct.unpack_from(">II", body)
        at, out = 8, cls(tracks.setdefault(number, Track(id=number)), movie, *defaults.get(number, (0, 0, 0)))
        for bit, form, name in ((TFHD_BASE, ">Q", "base"), (TFHD_DESCRIPTION, ">I", None), (TFHD_TICKS, ">I", "ticks"), (TFHD_SIZE, ">I", "size"), (TFHD_FLAGS, ">I", "flags")):
            if bits & bit:
                if name:
                    setattr(out, name, struct.unpack_from(form, body, at)[0])
                at += struct.calcsize(form)
        return out

    def run(self, body: bytes) -> None:
        """Appends the samples of a trun; without an offset they follow the run before."""
        bits, n = struct.unpack_from(">II", body)
        at, start, first = 8, self.base, None
        if bits & TRUN_OFFSET:
            start, at = self.base + struct.unpack_from(">i", body, at)[0], at + 4
        if bits & TRUN_FIRST_FLAGS:
            first, at = struct.unpack_from(">I", body, at)[0], at + 4
        names = [name for bit, name in ((TRUN_TICKS, "ticks"), (TRUN_SIZE, "size"), (TRUN_FLAGS, "flags"), (TRUN_COMPOSITION, "composition")) if bits & bit]
        if len(body) < at + 4 * n * len(names):
            raise ValueError("trun is cut off")
        given = dict(zip(names, np.frombuffer(body, ">u4", n * len(names), at).astype(np.int64).reshape(n, len(names)).T, strict=True))
        size, ticks, flags = (given.get(name, np.full(n, default, np.int64)) for name, default in (("size", self.size), ("ticks", self.ticks), ("flags", self.flags)))
        if first is not None and n:
            flags = np.concatenate(([first], flags[1:]))
        composition = given.get("composition", np.zeros(n, np.int64))
        composition = composition - ((composition >> 31) << 32) if body[0] else composition
        ends = start + np.cumsum(size)
        self.track.runs.append((ends - size, ends, ticks, composition, flags & NOT_SYNC == 0))
        if n:
            self.base = int(ends[-1])


def read_container(data) -> list[Track]:
    """The tracks of a container, from its headers alone."""
    tracks: list[Track] = []
    by_id: dict[int, Track] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    fragment: list[_Fragment] = []

    def walk(start: int, end: int, parents: tuple[bytes, ...], movie: int) -> None:
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
            if kind in CONTAINERS:
                # A fragment's offsets count from the start of its moof box.
                walk(a, b, (*parents, kind), a - 8 if kind == b"moof" else movie)
                continue
            body = bytes(data[a:b]) if parents else b""
            if kind == b"trex":
                number, _, ticks, size, flags = struct.unpack_from(">5I", body, 4)
                defaults[number] = ticks, size, flags
            elif kind == b"tfhd":
                fragment[:] = [_Fragment.of(body, movie, by_id, defaults)]
                if fragment[0].track not in tracks:
                    tracks.append(fragment[0].track)
            elif kind == b"trun":
                if not fragment or b"traf" not in parents:
                    raise ValueError("a trun without its tfhd")
                fragment[0].run(body)
            elif b"trak" in parents:
                track = tracks[-1]
                if kind == b"tkhd":
                    track.id = struct.unpack_from(">I", body, 20 if body[0] else 12)[0]
                    by_id[track.id] = track
                elif kind == b"mdhd":
                    track.timescale, track.duration = struct.unpack_from(">IQ" if body[0] else ">II", body, 20 if body[0] else 12)
                elif kind == b"hdlr":
                    track.handler = body[8:12].decode("latin-1")
                elif kind == b"stsd":
                    track.codec = body[12:16].decode("latin-1")
                    if track.handler == "vide":
                        track.width, track.height = struct.unpack_from(">HH", body, 40)
                    elif track.handler == "soun":
                        track.channels = struct.unpack_from(">H", body, 32)[0]
                elif b"stbl" in parents:
                    track.tables[kind] = body

    try:
        walk(0, len(data), (), 0)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a header is cut off: {e}") from e
    return tracks


def merged_ranges(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Ranges in order, neighbours that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in ranges.tolist():
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _track_features(track: Track) -> dict:
    ranges = track.ranges()
    keys = ranges[track.keyframes()]
    duration = track.ticks() / track.timescale if track.timescale else 0.0
    return {"handler": track.handler, "codec": track.codec, "width": track.width, "height": track.height, "frames": len(ranges), "duration": duration, "keyframe_start": keys[:, 0].tolist(), "keyframe_end": keys[:, 1].tolist(), "ranges": merged_ranges(ranges)}


def features(data: bytes) -> dict:
    """What ``media_features`` stores of one container: of its first track, and of all in ``tracks``."""
    tracks = [_track_features(x) for x in read_container(data)]
    if not tracks:
        raise ValueError("no track")
    return tracks[0] | {"tracks": [{k: v for k, v in x.items() if k != "ranges"} for x in tracks]}


MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, codec string, frames bigint, duration double, keyframe_start array<bigint>, keyframe_end array<bigint>, feature string, tracks array<struct<handler:string,codec:string,width:int,height:int,frames:bigint,duration:double,keyframe_start:array<bigint>,keyframe_end:array<bigint>>>, error string"


#: Rows, and bytes of more than one row, that a worker holds as Python objects at a time; batches from Spark hold up to 64 MB.
PART_ROWS, PART_BYTES = 256, 1 << 20


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, by the bytes of ``column``."""
    for batch in batches:
        at = held = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if i > at and (held + n > PART_BYTES or i - at == PART_ROWS):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if batch.num_rows:
            yield batch.slice(at)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, "text"):
        texts = part.column("text").to_pylist()
        media = [build_container(payload_of(x)) for x in texts]
        sizes = [len((x or "").encode()) for x in texts]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored form of each row's text; no shuffle."""
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_build, MEDIA)


def _describe(media: bytes) -> dict:
    try:
        found = features(media)
    except (ValueError, IndexError) as e:
        return {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "error": str(e) or "no track"}
    payload = b"".join([media[a:b] for a, b in found["ranges"]])
    keys = list(accumulate((zlib.crc32(struct.pack(">QQ", a, b)) for a, b in zip(found["keyframe_start"], found["keyframe_end"], strict=True)), lambda x, y: (x * 31 + y) & 0xFFFFFFFF))
    at = lambda i: f"{found['keyframe_start'][i]}-{found['keyframe_end'][i]}" if keys else "none"
    text = f"codec={found['codec'].strip()};size={found['width']}x{found['height']};frames={found['frames']};ms={round(found['duration'] * 1000)};keyframes={len(keys)};first={at(0)};last={at(-1)};index={keys[-1] if keys else 0:08x}"
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": text, **{k: found[k] for k in ("codec", "frames", "duration", "keyframe_start", "keyframe_end", "tracks")},
    }


TRACKS = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int64()), ("duration", pa.float64()), ("keyframe_start", pa.list_(pa.int64())), ("keyframe_end", pa.list_(pa.int64()))]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "codec": pa.string(), "frames": pa.int64(), "duration": pa.float64(), "keyframe_start": pa.list_(pa.int64()), "keyframe_end": pa.list_(pa.int64()), "feature": pa.string(), "tracks": TRACKS, "error": pa.string()}
    for part in _parts(batches, "media"):
        found = [_describe(x or b"") for x in part.column("media").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array([x.get(k) for x in found], t) for k, t in kinds.items())], names=["doc_id", "n_bytes", *kinds])


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES of stored containers (doc_id, n_bytes, media); no shuffle."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)
