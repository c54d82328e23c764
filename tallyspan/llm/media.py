"""Media columns: ISO media containers written, walked and read back without decoding payloads.

``pack`` stores bytes as an uncompressed 8-bit grey video track: frames of 16 x 12 samples, a key frame every
KEY_EVERY frames, chunks of CHUNK frames. ``walk`` follows the nested boxes of any such file (32- and 64-bit sizes and size 0)
and ``index`` decodes the sample tables stsd, stts, stsc, stsz, stco or co64, and stss into codec, time scale, duration and
byte ranges; payload bytes are only ever sliced.

Defined results: null texts are empty and give one frame of blanks; equal texts give equal files; null media give null
columns; bytes that are no ISO media file, or have no track, give codec ``none``, no samples and no ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of the track that is written.
WIDTH, HEIGHT, TICKS, KEY_EVERY, CHUNK = 16, 12, 25, 12, 8
FRAME = WIDTH * HEIGHT
#: Levels of a path that are kept apart.
DEEPEST = 8
#: Boxes that hold boxes.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


_MATRIX = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
_ENTRY = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), b"\0" * 32, struct.pack(">Hh", 40, -1))
_DATA_REF = box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1")))
_HANDLER = full(b"hdlr", b"\0" * 4, b"vide", b"\0" * 12, b"samples\0")
_TYPE = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")


def pack(data: bytes) -> bytes:
    """A file that holds the bytes, filled up with blanks to whole frames, at least one."""
    data = data + b" " * (-len(data) % FRAME if data else FRAME)
    n = len(data) // FRAME
    begin = len(_TYPE) + (8 if len(data) + 8 < 1 << 32 else 16)
    chunks = begin + np.arange(0, n, CHUNK, dtype=np.int64) * FRAME
    wide = begin + len(data) >= 1 << 32
    last = n - (len(chunks) - 1) * CHUNK
    runs = [(1, CHUNK, 1), (len(chunks), last, 1)] if last < CHUNK and len(chunks) > 1 else [(1, last if len(chunks) == 1 else CHUNK, 1)]
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), _ENTRY),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TICKS, n, 0x55C4, 0)), _HANDLER, box(b"minf", full(b"vmhd", b"\0" * 8), _DATA_REF, table))
    header = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 16, _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
    movie = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TICKS, n, 1 << 16, 256), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
    return b"".join((_TYPE, box(b"mdat", data), box(b"moov", movie, box(b"trak", header, media))))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte, end) of the content of every box, parents before children; a damaged size ends its parent's walk."""
    open_: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_:
        path, start, end = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            continue
        open_.append((path, start + size, end))
        # Paths deeper than any container's are kept at their end.
        inner = (*path[:DEEPEST], kind)
        yield inner, start + head, start + size
        if kind in PARENTS:
            open_.append((inner, start + head, start + size))


class Damaged(ValueError):
    """A table that does not fit its box, the file or the other tables."""


def _sound(test: bool) -> None:
    if not test:
        raise Damaged


class Index:
    """The first track with a sample table: codec, time scale, duration, and each sample's place.

    A file without such a track has the codec ``none``; one whose tables are damaged has the codec ``damaged``; both have no samples. Nothing
    is read beyond a box, and nothing is laid out by a count that the box or the file is too short for.
    """

    def __init__(self, data: bytes):
        self.codec, self.scale, self.duration = "none", 0, 0
        self.starts = self.sizes = self.keys = np.zeros(0, dtype=np.int64)
        at: dict[bytes, tuple[int, int]] = {}
        for path, a, b in walk(data):
            if path[:2] == (b"moov", b"trak") and path[-1] not in at and b"stco" not in at and b"co64" not in at:
                at[path[-1]] = a, b
        offsets = b"co64" if b"co64" in at else b"stco"
        if not {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz", offsets} <= at.keys():
            return
        try:
            found = self._tables(data, at, offsets)
        except Damaged:
            self.codec = "damaged"
            return
        self.codec, self.scale, self.duration, self.starts, self.sizes, self.keys = found

    @staticmethod
    def _tables(data: bytes, at: dict[bytes, tuple[int, int]], offsets: bytes) -> tuple[str, int, int, np.ndarray, np.ndarray, np.ndarray]:
        def number(kind: bytes, skip: int) -> int:
            begin, end = at[kind]
            _sound(begin + skip + 4 <= end)
            return struct.unpack_from(">I", data, begin + skip)[0]

        def table(kind: bytes, skip: int, width: int, form: str = ">u4") -> np.ndarray:
            begin, end = at[kind]
            count, cell = number(kind, skip - 4) * width, np.dtype(form).itemsize
            _sound(begin + skip + count * cell <= end)
            return np.frombuffer(data, dtype=form, count=count, offset=begin + skip).astype(np.int64).reshape(-1, width)

        number(b"stsd", 12)
        codec = data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16].decode("latin-1").strip()
        version = number(b"mdhd", 0) >> 24
        scale = number(b"mdhd", 20 if version == 1 else 12)
        times = table(b"stts", 8, 2)
        duration = sum(n * d for n, d in times.tolist())
        _sound(duration < 1 << 63)

        fixed, n = number(b"stsz", 4), number(b"stsz", 8)
        _sound(n * fixed <= len(data))
        sizes = np.full(n, fixed, dtype=np.int64) if fixed else table(b"stsz", 12, 1).ravel()
        _sound(int(times[:, 0].sum()) == n)
        chunks = table(offsets, 8, 1, ">u8" if offsets == b"co64" else ">u4").ravel()
        runs = table(b"stsc", 8, 3)
        edges = np.append(runs[:, 0] - 1, len(chunks))
        _sound(edges[0] == 0 and bool((np.diff(edges) >= 0).all()))
        _sound(sum(c * k for c, k in zip(np.diff(edges).tolist(), runs[:, 1].tolist())) == n)
        per = np.repeat(runs[:, 1], np.diff(edges))
        chunk = np.repeat(np.arange(len(chunks)), per)
        first = np.cumsum(per) - per
        ahead = np.cumsum(sizes) - sizes
        starts = chunks[chunk] + ahead - ahead[first[chunk]] if n else np.zeros(0, dtype=np.int64)
        _sound(bool(((starts >= 0) & (starts <= len(data) - sizes)).all()))
        keys = table(b"stss", 8, 1).ravel() - 1 if b"stss" in at else np.arange(n)
        _sound(bool(((keys >= 0) & (keys < n)).all()))
        return codec, scale, duration, starts, sizes, keys

    def read(self, data: bytes) -> bytes:
        """The samples' bytes in order; neighbouring samples are sliced together."""
        if not len(self.starts):
            return b""
        cut = np.flatnonzero(self.starts[1:] != self.starts[:-1] + self.sizes[:-1]) + 1
        begin = self.starts[np.concatenate([[0], cut])]
        last = np.concatenate([cut - 1, [len(self.starts) - 1]])
        return b"".join(data[a:b] for a, b in zip(begin.tolist(), (self.starts[last] + self.sizes[last]).tolist()))


def pack_column(text: Column) -> Column:
    """Binary: the file that holds a text's UTF-8 bytes."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(parts):
            yield pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in part.to_pylist()], pa.binary())

    return run(text)


def index_column(media: Column) -> Column:
    """struct<codec, time_scale, duration, samples, key_frames: array<struct<first, end>>>, byte ranges in the file."""

    @F.arrow_udf("codec string, time_scale long, duration long, samples long, key_frames array<struct<first: long, end: long>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(parts):
            found = [None if m is None else Index(m) for m in part.to_pylist()]
            rows = [x or Index(b"") for x in found]
            first = [x.starts[x.keys] for x in rows]
            ends = np.concatenate([*(f + x.sizes[x.keys] for f, x in zip(first, rows)), np.zeros(0, dtype=np.int64)])
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate([*first, np.zeros(0, dtype=np.int64)])), pa.array(ends)], names=["first", "end"])
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)), spans)
            cols = [pa.array([x.codec for x in rows], pa.string()), *(pa.array([int(f(x)) for x in rows], pa.int64()) for f in (lambda x: x.scale, lambda x: x.duration, lambda x: len(x.starts))), keys]
            mask = pa.array([x is None for x in found], pa.bool_())
            yield pa.StructArray.from_arrays(cols, names=["codec", "time_scale", "duration", "samples", "key_frames"], mask=mask)

    return run(media)


def read_column(media: Column) -> Column:
    """Binary: the samples' bytes, read by the file's own tables."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(parts):
            yield pa.array([None if m is None else Index(m).read(m) for m in part.to_pylist()], pa.binary())

    return run(media)


def media_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with media (the file), track (its index) and payload (its samples read back)."""
    out = docs.withColumn("media", pack_column(F.col(text_col).cast("string")))
    return out.withColumn("track", index_column(F.col("media"))).withColumn("payload", read_column(F.col("media")))
