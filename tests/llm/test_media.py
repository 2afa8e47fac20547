"""GIF columns: exact round trips and the parts of the format a writer need not use."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from joblattice.llm import media


@pytest.mark.parametrize("size", [1, 2, 30, 61, 4096, 4097, 9000])
def test_round_trip(size):
    rng = random.Random(size)
    for payload in (rng.randbytes(64 * size), bytes(64 * size), (b"the same words " * 64 * size)[: 64 * size]):
        _, frames = media.read_gif(media.write_gif(payload))
        assert b"".join(f.samples.tobytes() for f in frames) == payload
        assert len(frames) == -(-size // media.FRAME_ROWS)


def hand_made(codes, width, height, least=2, flags=0, before=b""):
    """A GIF of four colours from codes of three bits."""
    bits = "".join(format(c, "03b")[::-1] for c in codes)
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return (
        b"GIF89a"
        + struct.pack("<HHBBB", width, height, 0x81, 0, 0)
        + palette
        + before
        + b"\x2c"
        + struct.pack("<HHHHB", 0, 0, width, height, flags)
        + bytes([least, len(data)])
        + data
        + b"\0\x3b"
    )


def test_interlaced_rows():
    # Clear codes between the samples keep the codes at three bits.
    codes = [4, 0, 4, 1, 4, 2, 4, 3, 5]
    _, (frame,) = media.read_gif(hand_made(codes, 1, 4, flags=0x40))
    # Stored order of four rows: 0, then 2 (every fourth from 2: rows 2), then 1 and 3.
    assert frame.samples.ravel().tolist() == [0, 2, 1, 3]


def test_transparency_and_disposal():
    palette = np.array([[10, 10, 10], [200, 0, 0]], dtype=np.uint8)
    frame = lambda samples, disposal, clear: media.Frame(
        0, 0, 2, 1, 5, disposal, clear, palette, np.array([samples], dtype=np.uint8)
    )
    frames = [frame([0, 0], media.KEEP, None), frame([1, 0], media.PREVIOUS, 0), frame([1, 1], media.BACKGROUND, None), frame([0, 1], 0, 0)]
    shown = [f[0].tolist() for f in media.rendered((2, 1), frames)]
    grey, red, none = [10, 10, 10, 255], [200, 0, 0, 255], [0, 0, 0, 0]
    assert shown == [[grey, grey], [red, grey], [red, red], [none, red]]


def test_delay_is_read():
    control = b"\x21\xf9\x04" + struct.pack("<BHB", (2 << 2) | 1, 25, 3) + b"\0"
    _, (frame,) = media.read_gif(hand_made([4, 0, 5], 1, 1, before=control))
    assert (frame.delay, frame.disposal, frame.transparent) == (25, 2, 3)


@pytest.mark.parametrize("data", [b"", b"JFIF", b"GIF89a" + bytes(7) + b"\x99"])
def test_other_bytes(data):
    with pytest.raises(ValueError):
        media.read_gif(data)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op9_gif_columns(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, payload = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        counts = np.bincount(np.frombuffer(payload, np.uint8) // 16, minlength=16).tolist()
        assert r.feature.endswith("histogram=" + ",".join(map(str, counts)))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "", 2), (2, "é" * 200_000, 3)], "doc_id bigint, text string, media int"
    )
    rows = media.read(media.store(docs)).collect()
    assert sorted(len(r.payload) for r in rows) == [64, 64, 64, 400_000]
    assert len({r.media for r in rows}) == 2
    assert media.read(media.store(docs.limit(0))).count() == 0


def animated():
    """Four frames of 2 x 1 in black, red, green and blue, the second partly transparent, then cleared."""

    def frame(samples, disposal, delay, clear=None, left=0):
        codes = [c for s in samples for c in (4, s)] + [5]
        bits = "".join(format(c, "03b")[::-1] for c in codes)
        bits += "0" * (-len(bits) % 8)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        control = struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0)
        place = struct.pack("<HHHHB", left, 0, len(samples), 1, 0)
        return b"\x21\xf9\x04" + control + b"\0\x2c" + place + bytes([2, len(data)]) + data + b"\0"

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    frames = [
        frame([1, 2], media.KEEP, 5),
        frame([3, 0], media.BACKGROUND, 7, clear=0),
        frame([0, 3], media.PREVIOUS, 9, clear=0),
        frame([2, 2], media.KEEP, 1, left=1),
    ]
    return b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x81, 0, 0) + palette + b"".join(frames) + b"\x3b"


def test_read_shows_frames(spark):
    df = spark.createDataFrame([(1, 0, animated())], "doc_id bigint, n_bytes bigint, media binary")
    (row,) = media.read(df).collect()
    none, red, green, blue = bytes(4), b"\xff\0\0\xff", b"\0\xff\0\xff", b"\0\0\xff\xff"
    # The second frame clears the whole screen, the third is taken back, the last is cut at the edge.
    shown = [red + green, blue + green, none + blue, none + green]
    assert bytes(row.payload) == bytes([1, 2, 3, 0, 0, 3, 2, 2])
    assert [bytes(f.shown_sha256) for f in row.frames] == [hashlib.sha256(s).digest() for s in shown]
    assert [(f.time, f.delay) for f in row.frames] == [(0, 5), (5, 7), (12, 9), (21, 1)]
    # Drawn pixels without and with the colour, of red, green and blue.
    ends = [[(c[0], c[15]) for c in (f.red, f.green, f.blue)] for f in row.frames]
    assert ends == [[(1, 1), (1, 1), (2, 0)], [(1, 0), (1, 0), (0, 1)], [(1, 0), (1, 0), (0, 1)], [(1, 0), (0, 1), (1, 0)]]


def test_bad_files_do_not_stop_a_table(spark):
    good = media.write_gif(media.payload_of("some text")[1])
    hostile = b"GIF89a" + bytes([255, 255, 255, 255, 0, 0, 0]) + b";"
    wide = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"," + bytes([0, 0, 0, 0, 255, 255, 255, 255, 0, 2, 0]) + b";"
    bad = [None, b"", b"GIF89a", b"PNG", good[:-1], good[: len(good) // 2], good[:14], hostile, wide]
    rows = [(i, 1, b) for i, b in enumerate([good, *bad])]
    found = media.read(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).orderBy("doc_id").collect()
    assert found[0].error is None and bytes(found[0].payload).startswith(b"some text")
    assert all(r.error and r.payload is None and r.frames is None and r.width is None for r in found[1:])


def test_a_wrong_code_size_is_a_bad_file():
    # Its entries would not fit any table; the reader must say so rather than fail otherwise.
    with pytest.raises(ValueError):
        media.read_gif(hand_made([4, 0, 5], 1, 1, least=200))
