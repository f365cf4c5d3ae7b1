"""ISO media containers in a binary column: write, walk, and index without decoding payloads.

``tracks`` walks the nested boxes of a file, decodes the sample tables of each track (``stts stsc stsz stz2 stco co64
stss``) and returns codec, duration and the byte range of every keyframe. Movie fragments are refused, not half read. ``wrap`` stores a payload losslessly as raw
video: 8 x 8 pixel frames of three 8-bit samples (192 bytes a frame), with a sync-sample table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoebox.llm.common import map_batches, texts_as_bytes

FRAME = 192
FRAMES_A_CHUNK = 16
KEY_EVERY = 12
TIMESCALE = 25
CODEC = b"raw "

#: Boxes that hold boxes (ISO/IEC 14496-12).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


class BadMedia(ValueError):
    """The bytes are not a container that can be indexed."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return _box(kind, bytes([version, 0, 0, 0]), *parts)


def _u4(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """Spaces are appended up to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b" ")


def wrap(payload: bytes) -> bytes:
    """A container around ``payload``, whose length is a positive multiple of 192; equal payloads give equal bytes."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_A_CHUNK)
    last = n - (chunks - 1) * FRAMES_A_CHUNK
    matrix = _u4([0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000])
    entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), _u4([0x480000, 0x480000, 0]), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1))
    runs = [(1, FRAMES_A_CHUNK, 1)] if last == FRAMES_A_CHUNK else [(1, last, 1)] if chunks == 1 else [(1, FRAMES_A_CHUNK, 1), (chunks, last, 1)]
    big = len(payload) > 2**32 - 2**20

    def moov(offsets) -> bytes:
        places = _full(b"co64", _u4([chunks]), np.asarray(offsets, ">u8").tobytes()) if big else _full(b"stco", _u4([chunks]), _u4(offsets))
        stbl = _box(
            b"stbl",
            _full(b"stsd", _u4([1]), entry),
            _full(b"stts", _u4([1, n, 1])),
            _full(b"stss", _u4([-(-n // KEY_EVERY)]), _u4(np.arange(1, n + 1, KEY_EVERY))),
            _full(b"stsc", _u4([len(runs)]), _u4(runs)),
            _full(b"stsz", _u4([FRAME, n])),
            places,
        )
        dinf = _box(b"dinf", _full(b"dref", _u4([1]), _box(b"url ", b"\0\0\0\1")))
        minf = _box(b"minf", _box(b"vmhd", b"\0\0\0\1", bytes(8)), dinf, stbl)
        mdhd = _full(b"mdhd", _u4([0, 0, TIMESCALE, n]), struct.pack(">HH", 0x55C4, 0))
        hdlr = _full(b"hdlr", _u4([0]), b"vide", bytes(12), b"frames\0")
        tkhd = _box(b"tkhd", b"\0\0\0\3", _u4([0, 0, 1, 0, n, 0, 0]), bytes(8), matrix, _u4([8 << 16, 8 << 16]))
        mvhd = _full(b"mvhd", _u4([0, 0, TIMESCALE, n, 0x10000]), b"\1\0", bytes(10), matrix, bytes(24), _u4([2]))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", _u4([512]), b"isomiso2")
    head = b"" if big else struct.pack(">I4s", len(payload) + 8, b"mdat")
    head = head or struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    size = len(moov(np.zeros(chunks, np.int64)))
    first = len(ftyp) + size + len(head)
    offsets = first + np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_A_CHUNK)
    return b"".join((ftyp, moov(offsets), head, payload))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple = (), depth: int = 0):
    """(path, body start, end) of every box, nested ones after their parent."""
    end = len(data) if end is None else end
    if depth > 16:
        raise BadMedia("boxes nest too deep")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise BadMedia("cut box header")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise BadMedia(f"box {kind!r} leaves its parent")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from boxes(data, body, stop, (*path, kind), depth + 1)
        start = stop


def _ints(data: memoryview, at: int, n: int, end: int, kind: str = ">u4") -> np.ndarray:
    if n < 0 or at + n * np.dtype(kind).itemsize > end:
        raise BadMedia("table longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def tracks(content: bytes) -> list[dict]:
    """Codec, handler, timescale, duration (in its ticks), samples, their byte ranges and the keyframes' numbers, by track.

    Ranges are arrays ``offset`` and ``size``; ``keys`` has sample indexes from 0 (all, without a sync table).
    Raises BadMedia for bytes without a track, with an incomplete one, or with movie fragments.
    """
    data, found = memoryview(content), []
    for path, body, end in boxes(data):
        if path[0] == b"moof":
            raise BadMedia("movie fragments are not indexed")
        if path[0] == b"moov" and path[-1] == b"trak":
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (body, end))
    if not found:
        raise BadMedia("no track")
    return [_track(data, f) for f in found]


def probe(content: bytes) -> dict:
    """The first video track of ``tracks``, or the first track where none is video."""
    found = tracks(content)
    return next((t for t in found if t["handler"] == "vide"), found[0])


def _track(data: memoryview, found: dict) -> dict:
    """Reads one track, given the places of its boxes by kind."""
    missing = [k.decode() for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc") if k not in found]
    if missing or not (b"stco" in found or b"co64" in found) or not (b"stsz" in found or b"stz2" in found):
        raise BadMedia("no complete track: " + ",".join(missing))
    try:
        at, _ = found[b"mdhd"]
        scale, duration = struct.unpack_from(">IQ" if data[at] == 1 else ">II", data, at + (20 if data[at] == 1 else 12))
        handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1")
        codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
        count = lambda kind: struct.unpack_from(">I", data, found[kind][0] + 4)[0]
        kind = b"stsz" if b"stsz" in found else b"stz2"
        at, end = found[kind]
        fixed, n = struct.unpack_from(">II", data, at + 4)
        if kind == b"stz2":
            bits = fixed & 0xFF
            if bits == 4:
                raw = _ints(data, at + 12, (n + 1) // 2, end, "u1")
                sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n]
            else:
                sizes = _ints(data, at + 12, n, end, {8: "u1", 16: ">u2"}[bits])
        else:
            if fixed and n * fixed > data.nbytes:
                raise BadMedia("more samples than bytes")
            sizes = np.full(n, fixed, np.int64) if fixed else _ints(data, at + 12, n, end)
        wide = b"co64" in found
        at, end = found[b"co64" if wide else b"stco"]
        places = _ints(data, at + 8, count(b"co64" if wide else b"stco"), end, ">u8" if wide else ">u4")
        at, end = found[b"stsc"]
        runs = _ints(data, at + 8, 3 * count(b"stsc"), end).reshape(-1, 3)
        # no field says more chunks or samples than there are: what a table may claim is cut before anything is repeated
        firsts = np.append(np.minimum(runs[:, 0], len(places) + 1), len(places) + 1)
        per_chunk = np.repeat(np.minimum(runs[:, 1], n), np.diff(firsts))
        per_chunk = np.diff(np.minimum(np.cumsum(per_chunk), n), prepend=0)
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
        if len(chunk) < n:
            raise BadMedia("chunks hold fewer samples than listed")
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, chunk)
        offset = places[chunk] + before - before[first]
        if n and (offset.min() < 0 or (offset + sizes).max() > data.nbytes):
            raise BadMedia("samples lie beyond the end")
        at, end = found[b"stts"]
        times = _ints(data, at + 8, 2 * count(b"stts"), end).reshape(-1, 2)
        keys = np.arange(n)
        if b"stss" in found:
            keys = _ints(data, found[b"stss"][0] + 8, count(b"stss"), found[b"stss"][1]) - 1
            if len(keys) and not 0 <= keys.min() <= keys.max() < n:
                raise BadMedia("a keyframe is no sample")
    except (struct.error, KeyError, IndexError, ValueError) as error:
        raise BadMedia(str(error)) from error
    return {"codec": codec, "handler": handler, "timescale": scale, "duration": int(duration or times.prod(axis=1).sum()), "samples": int(n), "offset": offset, "size": sizes, "keys": keys}


def read_back(content: bytes, info: dict) -> bytes:
    """The stored samples in order, joined; neighbouring ranges are read together."""
    offset, size = info["offset"], info["size"]
    breaks = np.flatnonzero(offset[1:] != (offset + size)[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(offset)) - 1
    view = memoryview(content)
    return b"".join(view[a:b] for a, b in zip(offset[firsts].tolist(), (offset + size)[lasts].tolist(), strict=True)) if len(offset) else b""


def media_table(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds what ``tracks`` finds to a table with a binary column.

    New columns media_codec, media_handler, media_seconds, media_samples, media_keyframes (array of byte ranges
    start/stop, stop exclusive) of the track that ``probe`` picks, media_tracks (the same of every track, in order) and
    media_error. Null, empty or malformed content gives nulls and the reason in media_error; the other columns pass
    through, and a column that already has one of these names is replaced.
    """
    fields = {"codec": "string", "handler": "string", "seconds": "double", "samples": "long", "keyframes": "array<struct<start:long,stop:long>>"}
    track = ",".join(f"{k}:{v}" for k, v in fields.items())
    added = T.StructType.fromDDL(", ".join(f"media_{k} {v}" for k, v in fields.items()) + f", media_tracks array<struct<{track}>>, media_error string")
    keep = [f for f in files.schema.fields if f.name not in added.names]
    at = [f.name for f in keep].index(content)

    def row(t: dict) -> dict:
        starts = t["offset"][t["keys"]]
        ranges = [{"start": a, "stop": b} for a, b in zip(starts.tolist(), (starts + t["size"][t["keys"]]).tolist(), strict=True)]
        return dict(zip(fields, (t["codec"], t["handler"], t["duration"] / t["timescale"] if t["timescale"] else None, t["samples"], ranges), strict=True))

    def make():
        def step(batch):
            rows = []
            for data in batch.column(at).to_pylist():
                try:
                    all_tracks = [row(t) for t in tracks(data or b"")]
                    first = next((t for t in all_tracks if t["handler"] == "vide"), all_tracks[0])
                    rows.append({"media_" + k: v for k, v in first.items()} | {"media_tracks": all_tracks})
                except BadMedia as error:
                    rows.append({"media_error": str(error)})
            yield {f.name: batch.column(j) for j, f in enumerate(keep)} | {k: [r.get(k) for r in rows] for k in added.names}

        return step

    return map_batches(files.select(*[F.col(f"`{f.name}`") for f in keep]), T.StructType(keep + added.fields), make)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores each text as a media file, probes the stored bytes and reads the payload back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (codec,
    handler, ticks a second, duration, samples, keyframes, and the CRC-32 of the keyframes' byte ranges) per row.
    Null text is empty; repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    """

    def make():
        def step(batch):
            rows = []
            for text in texts_as_bytes(batch.column(1)):
                stored = wrap(pad(text))
                info = probe(stored)
                payload = read_back(stored, info)
                keys = np.stack([info["offset"][info["keys"]], (info["offset"] + info["size"])[info["keys"]]], 1)
                feature = f"{info['codec'].strip()}/{info['handler']}/{info['timescale']}/{info['duration']}/{info['samples']}/{len(keys)}/{zlib.crc32(keys.astype('<i8').tobytes()):08x}"
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield {"doc_id": batch.column(0)} | {k: [r[j] for r in rows] for j, k in enumerate(names)}

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, make)
