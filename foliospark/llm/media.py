"""Media columns of ISO base media files (MP4 and its kin).

parse() walks the nested boxes of a file and decodes its sample tables into codec, time scale, duration,
sample count and the byte ranges of key frames; payload bytes are never decoded. wrap() writes the smallest
such file: one audio track of 8-bit samples in frames of fixed size.

Counts in a file are held against the box and the file they are in before anything is read or made of them, so a
file costs no more than its size. Defined results: a malformed, contradictory, empty or NULL file gives NULL columns and
`error`, so does one in movie fragments, which are not decoded; NULL text is empty text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.common import read, stash

FRAME, TIMESCALE, KEY_EVERY = 192, 8000, 16
DEEPEST = 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    inner = b"".join(body)
    return struct.pack(">I4s", 8 + len(inner), kind) + inner


def full_box(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def wrap(payload: bytes, frame: int = FRAME) -> bytes:
    """payload (a positive multiple of frame bytes) as the samples of one track, in one chunk."""
    n = len(payload) // frame
    ticks = n * frame
    keys = range(1, n + 1, KEY_EVERY)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHH4xI", 1, 1, 8, TIMESCALE << 16))

    def moov(at: int) -> bytes:
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">3I", 1, n, frame)),
            full_box(b"stss", struct.pack(f">{1 + len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">4I", 1, 1, n, 1)),
            full_box(b"stsz", struct.pack(">2I", frame, n)),
            full_box(b"stco", struct.pack(">2I", 1, at)),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">4IHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
        )
        track = full_box(b"tkhd", struct.pack(">5I8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, bytes(8), flags=3)
        head = full_box(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, box(b"trak", track, media))

    at = len(ftyp) + len(moov(0)) + 8
    return b"".join((ftyp, moov(at), box(b"mdat", payload)))


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of body, end) of the boxes in data[start:end]; raises ValueError on a bad size."""
    while start < end:
        if end - start < 8:
            raise ValueError("box header cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("box header cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        size = size or end - start  # 0: up to the end
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, body, start + size
        start += size


def leaves(data: bytes, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    if len(path) > DEEPEST:
        raise ValueError("boxes nested too deep")
    for kind, a, b in boxes(data, start, end):
        if kind in NESTED:
            if kind == b"trak":
                yield (*path, b"trak"), a, a
            yield from leaves(data, a, b, (*path, kind))
        else:
            yield (*path, kind), a, b


def table(data: bytes, box: tuple[int, int], form: str, skip: int = 4) -> Iterator[tuple]:
    """The rows of a table: version and flags, then (after skip bytes) a count, then rows of a form, all inside its box."""
    at, end = box
    if end - at < skip + 4:
        raise ValueError("table cut off")
    n = struct.unpack_from(">I", data, at + skip)[0]
    first, size = at + skip + 4, struct.calcsize(form)
    if first + n * size > end:
        raise ValueError("table longer than its box")
    return struct.iter_unpack(form, data[first : first + n * size])


def sample_sizes(data: bytes, t: dict[bytes, tuple[int, int]]) -> list[int]:
    """The size of each sample, from a table of full, equal or compact sizes."""
    if b"stsz" in t:
        at, end = t[b"stsz"]
        fixed, n = struct.unpack_from(">2I", data, at + 4) if end - at >= 12 else (0, 0)
        if not fixed:
            return [x for (x,) in table(data, t[b"stsz"], ">I", 8)]
        if fixed * n > len(data):
            raise ValueError("samples larger than the file")
        return [fixed] * n
    at, end = t[b"stz2"]
    if end - at < 12:
        raise ValueError("table cut off")
    width, n = struct.unpack_from(">BI", data, at + 7)
    raw = data[at + 12 : at + 12 + (n * width + 7) // 8]
    if width not in (4, 8, 16) or at + 12 + (n * width + 7) // 8 > end:
        raise ValueError("table longer than its box")
    if width == 4:
        return [x for b in raw for x in (b >> 4, b & 15)][:n]
    return [x for (x,) in struct.iter_unpack(">B" if width == 8 else ">H", raw)]


def sample_ranges(data: bytes, t: dict[bytes, tuple[int, int]]) -> list[tuple[int, int]]:
    """(offset, length) of each sample, from the size, chunk and offset tables, which have to agree."""
    sizes = sample_sizes(data, t)
    chunks = [x for (x,) in (table(data, t[b"stco"], ">I") if b"stco" in t else table(data, t[b"co64"], ">Q"))]
    runs = list(table(data, t[b"stsc"], ">3I"))
    out: list[tuple[int, int]] = []
    for k, (first, per_chunk, _) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)
        if not 1 <= first <= last + 1 <= len(chunks) + 1 or (last - first + 1) * per_chunk > len(sizes) - len(out):
            raise ValueError("chunks do not hold the samples")
        for chunk in range(first - 1, last):
            at = chunks[chunk]
            for size in sizes[len(out) : len(out) + per_chunk]:
                out.append((at, size))
                at += size
    if len(out) < len(sizes):
        raise ValueError("chunks do not hold the samples")
    return out


def parse(data: bytes | None) -> dict:
    """Brand, and of the first track with samples: codec, timescale, duration in ticks, n_samples, keyframes
    as (offset, length) and all sample ranges."""
    none = dict(brand=None, codec=None, timescale=None, duration=None, n_samples=None, keyframes=None, samples=None, error=None)
    if not data:
        return none | {"error": "empty"}
    try:
        brand, tracks, fragments = None, [], False
        for path, a, b in leaves(data, 0, len(data)):
            if path == (b"ftyp",):
                brand = data[a : min(a + 4, b)].decode("latin-1")
            elif path[-1] in (b"moof", b"mvex"):
                fragments = True
            elif path[-1] == b"trak":
                tracks.append({})
            elif path[:2] == (b"moov", b"trak"):
                tracks[-1][path[-1]] = (a, b)
        if fragments:
            return none | {"brand": brand, "error": "movie fragments are not decoded"}
        t = next((t for t in tracks if {b"stsd", b"stts", b"stsc", b"mdhd"} <= t.keys() and (b"stsz" in t or b"stz2" in t)), None)
        if t is None:
            return none | {"brand": brand, "error": "no track"}
        at, end = t[b"mdhd"]
        long = data[at] == 1
        if end - at < (36 if long else 24) or t[b"stsd"][1] - t[b"stsd"][0] < 16:
            raise ValueError("header cut off")
        timescale, _ = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
        ranges = sample_ranges(data, t)
        times = list(table(data, t[b"stts"], ">2I"))
        if sum(n for n, _ in times) != len(ranges):
            raise ValueError("times of other samples than there are")
        keys = [k for (k,) in table(data, t[b"stss"], ">I")] if b"stss" in t else range(1, len(ranges) + 1)
        if any(not 1 <= k <= len(ranges) for k in keys):
            raise ValueError("key frame that is no sample")
        codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
        duration = sum(n * d for n, d in times)
        return dict(brand=brand, codec=codec, timescale=timescale, duration=duration, n_samples=len(ranges), keyframes=[ranges[k - 1] for k in keys], samples=ranges, error=None)
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return none | {"error": f"{type(e).__name__}: {e}"[:200]}


COLUMNS = "brand string, codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>, error string"


def media_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, media) -> id and the columns of parse()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1)):
                p = parse(m.as_py())
                p["keyframes"] = None if p["keyframes"] is None else [{"offset": x, "length": y} for x, y in p["keyframes"]]
                rows.append({id_col: i} | {k: v for k, v in p.items() if k != "samples"})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([b.schema.field(0), *ARROW]))

    return media.select(id_col, media_col).mapInArrow(run, f"{id_col} {media.schema[id_col].dataType.simpleString()}, {COLUMNS}")


ARROW = [
    pa.field("brand", pa.string()), pa.field("codec", pa.string()), pa.field("timescale", pa.int64()), pa.field("duration", pa.int64()), pa.field("n_samples", pa.int64()),
    pa.field("keyframes", pa.list_(pa.struct([pa.field("offset", pa.int64()), pa.field("length", pa.int64())]))), pa.field("error", pa.string()),
]


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media: the text, padded with spaces to frames, as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, files = [], []
            for t in b.column(1):
                raw = (t.as_py() or "").encode()
                sizes.append(len(raw))
                files.append(wrap(raw + b" " * (-len(raw) % FRAME if raw else FRAME)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature_of(p: dict) -> str:
    ranges = ",".join(f"{a}+{n}" for a, n in p["keyframes"])
    return f"{p['brand']}/{p['codec'].strip()}/{p['timescale']}/{p['duration']}/{p['n_samples']}/{ranges}"


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stash(store_texts(read(spark, sf_dir, "documents")), "media")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.column(2):
                data = m.as_py()
                p = parse(data)
                payload = b"".join(data[a : a + n] for a, n in p["samples"])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(p)))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
