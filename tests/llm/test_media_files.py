"""Malformed, contradictory and unusual media files."""

import random
import resource
import struct
import time

import pytest

from foliospark.llm import media

GOOD = media.wrap(bytes(range(192)) * 40)


def with_count(kind: bytes, skip: int, value: int) -> bytes:
    """A good file with one count of a table changed."""
    at = GOOD.index(kind) + 4 + skip
    return GOOD[:at] + struct.pack(">I", value) + GOOD[at + 4 :]


COUNTS = [(b"stsz", 8), (b"stts", 4), (b"stts", 8), (b"stss", 4), (b"stss", 8), (b"stsc", 4), (b"stsc", 8), (b"stsc", 12), (b"stco", 4), (b"stsz", 4)]


@pytest.mark.parametrize("kind,skip", COUNTS)
@pytest.mark.parametrize("value", [0, 2**26, 2**31, 2**32 - 1])
def test_counts_larger_than_the_file_are_errors(kind, skip, value):
    data = with_count(kind, skip, value)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    p = media.parse(data)
    assert time.perf_counter() - began < 0.5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KB
    if value or (kind, skip) != (b"stss", 4):  # no key frame at all is a table that holds nothing
        assert p["error"] and p["n_samples"] is None and p["samples"] is None
    else:
        assert p["error"] is None and p["keyframes"] == []


def test_flipped_bytes_never_raise_or_grow():
    draw = random.Random(4)
    head = GOOD.index(b"mdat")
    errors, began = 0, time.perf_counter()
    for _ in range(4000):
        data = bytearray(GOOD)
        for _ in range(draw.randrange(1, 4)):
            data[draw.randrange(head)] = draw.randrange(256)
        if draw.random() < 0.2:
            del data[draw.randrange(len(data)) :]
        p = media.parse(bytes(data))
        errors += p["error"] is not None
        assert p["error"] is None or p["samples"] is None
        assert len(p["samples"] or []) <= len(data)
    assert errors > 500 and time.perf_counter() - began < 60


def movie(*sizes_box: bytes, n: int = 5, extra: bytes = b"") -> bytes:
    full = media.full_box
    stbl = media.box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(8))), full(b"stts", struct.pack(">3I", 1, n, 10)), full(b"stsc", struct.pack(">4I", 1, 1, n, 1)),
        *sizes_box, full(b"stco", struct.pack(">2I", 1, 500)),
    )
    mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">4IHH", 0, 0, 600, 80, 0, 0)), media.box(b"minf", stbl))
    return media.box(b"ftyp", b"mp42") + media.box(b"moov", extra, media.box(b"trak", mdia))


@pytest.mark.parametrize("width,sizes", [(4, [1, 2, 15, 0, 7]), (8, [1, 200, 3, 4, 255]), (16, [1, 20_000, 65_535, 3, 4])])
def test_compact_sizes(width, sizes):
    if width == 4:
        raw = bytes(a << 4 | b for a, b in zip(sizes[::2], [*sizes[1::2], 0]))
    else:
        raw = struct.pack(f">{len(sizes)}{'B' if width == 8 else 'H'}", *sizes)
    data = movie(media.full_box(b"stz2", struct.pack(">3xBI", width, len(sizes)), raw))
    p = media.parse(data)
    assert p["error"] is None and [n for _, n in p["samples"]] == sizes
    assert p["samples"][2] == (500 + sizes[0] + sizes[1], sizes[2])
    for width, count in ((width, 2**32 - 1), (5, 5), (width, 6 if width > 4 else 7)):
        assert media.parse(movie(media.full_box(b"stz2", struct.pack(">3xBI", width, count), raw)))["error"]


def test_fragments_say_so():
    sizes = media.full_box(b"stsz", struct.pack(">2I5I", 0, 5, 1, 2, 3, 4, 5))
    assert media.parse(movie(sizes))["n_samples"] == 5
    for data in (movie(sizes, extra=media.box(b"mvex", bytes(8))), movie(sizes) + media.box(b"moof", bytes(8))):
        p = media.parse(data)
        assert p["error"] == "movie fragments are not decoded" and p["n_samples"] is None and p["brand"] == "mp42"


def test_deep_nesting_is_an_error():
    data = b""
    for _ in range(3000):
        data = media.box(b"moov", data)
    assert "deep" in media.parse(data)["error"]


def test_tables_that_disagree_are_errors():
    sizes = media.full_box(b"stsz", struct.pack(">2I5I", 0, 5, 1, 2, 3, 4, 5))
    assert media.parse(movie(sizes, n=4))["error"] and media.parse(movie(sizes, n=6))["error"]
