"""GIF columns: texts stored as pictures, read back with timed frames (operator 9).

``store`` writes each payload as a GIF89a: 64 samples a row, frames of at most
``FRAME_ROWS`` rows, a grey palette in which sample i has colour i, so that the
samples are the payload. ``read`` is a general decoder: it unpacks the LZW codes of
every frame, applies local or global palettes, interlacing, transparency and
disposal, and gives one row per picture with the raw samples of all frames and its frames:
place, delay, time from the start, a digest of the whole screen as shown (RGBA) and
histograms of red, green and blue over the pixels that the frame draws.

Both work on one row at a time inside Arrow batches: no shuffle, and a task holds a
few rows. A lost task repeats its rows.

Defined results: a null or empty text is 64 zero bytes; repeated rows and equal texts
give equal values; an empty table gives no row; other columns are not read. ``read`` gives
a row without media, with bytes that are no GIF or a cut one, or with a picture of more than
``MOST_PIXELS`` pixels null columns and says why in ``error``, which is null otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm.common import documents, ship

ROW = 64
FRAME_ROWS = 4096
DELAY = 4  # hundredths of a second
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3  # disposal of a frame (fixed values of the format)


# Writing


def _codes(data: bytes) -> list[int]:
    """Greedy LZW codes of 8-bit samples, with clear codes and the end code."""
    table: dict[int, int] = {}
    known, after = table.get, 258
    codes = [256]
    out = codes.append
    prefix = data[0]
    for byte in data[1:]:
        key = prefix << 8 | byte
        code = known(key)
        if code is None:
            out(prefix)
            if after < 4096:
                table[key] = after
                after += 1
            else:
                out(256)
                table.clear()
                after = 258
            prefix = byte
        else:
            prefix = code
    out(prefix)
    out(257)
    return codes


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bits of each code: 9 after a clear code, one more when the reader's table fills."""
    at = np.arange(len(codes))
    clears = np.flatnonzero(codes == 256)
    last = clears[np.maximum(np.searchsorted(clears, at, side="left") - 1, 0)]
    # Before the n-th code after a clear code the reader has 258 + n - 2 entries.
    entries = 258 + np.maximum(at - last - 2, 0)
    widths = np.clip(np.frexp(entries)[1], 9, 12)
    widths[0] = 9
    return widths


def _packed(codes: list[int]) -> bytes:
    array = np.asarray(codes, dtype=np.int64)
    widths = _widths(array)
    bits = np.unpackbits(array.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    used = np.arange(16) < widths[:, None]
    return np.packbits(bits[used], bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    parts = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes([len(p)]) + p for p in parts) + b"\0"


def write_gif(payload: bytes, delay: int = DELAY) -> bytes:
    """A GIF whose samples, frame after frame, are the payload (a multiple of 64 bytes)."""
    rows = len(payload) // ROW
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), grey]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[ROW * top : ROW * (top + FRAME_ROWS)]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", KEEP << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0) + b"\x08")
        out.append(_blocks(_packed(_codes(part))))
    return b"".join([*out, b"\x3b"])


# Reading


MOST_PIXELS = 1 << 24  # of a screen or frame that is read: 64 MB as RGBA


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray  # height x width


@functools.cache
def _after_clear(least: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(entries, widths of the codes, their ends) behind a clear code, up to a full table and on."""
    clear, end = 1 << least, (1 << least) + 1
    entries = [bytes([i]) for i in range(clear)] + [b"", b""]
    first = np.concatenate([[0], np.arange(4096 - end)])
    widths = np.clip(np.frexp(end + 1 + first)[1], least + 1, 12).astype(np.int64)
    return entries, widths, np.cumsum(widths)


def _lzw(data: bytes, least: int, expected: int) -> bytes:
    """Samples of a code stream. Reads past a missing end code; stops at ``expected``."""
    clear, end = 1 << least, (1 << least) + 1
    base, growing, growing_ends = _after_clear(least)
    # A code lies within three bytes.
    raw = np.frombuffer(data + b"\0\0", dtype=np.uint8).astype(np.int32)
    triples = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    n_bits = 8 * len(data)
    widths, width_ends = growing, growing_ends
    out, done, at = [], 0, 0
    table, previous = list(base), None
    while at < n_bits and done < expected:
        n = int(np.searchsorted(width_ends, n_bits - at, side="right"))
        if n == 0:
            break
        ends = at + width_ends[:n]
        starts = ends - widths[:n]
        codes = triples[starts >> 3] >> (starts & 7) & (1 << widths[:n]) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
                if previous is not None and len(table) < 4096:
                    table.append(previous + entry[:1])
            elif code == len(table) and previous is not None:
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code before its entry")
            out.append(entry)
            done += len(entry)
            previous = entry
        if len(stops):
            if codes[stop] == end:
                break
            at, table, previous = int(ends[stop]), list(base), None
            widths, width_ends = growing, growing_ends
        else:
            at = int(ends[n - 1])
            widths = np.full(4096, 12)  # a full table without a clear code
            width_ends = np.cumsum(widths)
    return b"".join(out)[:expected]


def _rows_of(samples: bytes, width: int, height: int, interlaced: bool) -> np.ndarray:
    grid = np.zeros((height, width), dtype=np.uint8)
    flat = np.frombuffer(samples, dtype=np.uint8)
    grid.ravel()[: len(flat)] = flat
    if not interlaced:
        return grid
    order = np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(grid)
    out[order] = grid
    return out


def read_gif(data: bytes) -> tuple[tuple[int, int], list[Frame]]:
    """((width, height) of the screen, frames)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        colours = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += size + 1
        at += 1
        return b"".join(parts)

    if width * height > MOST_PIXELS:
        raise ValueError("screen too large")
    shared = palette(flags & 7) if flags & 0x80 else np.zeros((2, 3), dtype=np.uint8)
    frames, control = [], (0, 0, None)
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body = blocks()
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, index if packed & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at)
            at += 9
            if w * h > MOST_PIXELS:
                raise ValueError("frame too large")
            colours = palette(local & 7) if local & 0x80 else shared
            least, at = data[at], at + 1
            samples = _rows_of(_lzw(blocks(), least, w * h), w, h, bool(local & 0x40))
            frames.append(Frame(left, top, w, h, control[1], control[0], control[2], colours, samples))
            control = (0, 0, None)
        else:
            raise ValueError("unknown GIF block")
    return (width, height), frames


def _colours(frame: Frame) -> np.ndarray:
    """RGBA of each of 256 samples; those beyond the palette are black."""
    colours = np.zeros((256, 4), dtype=np.uint8)
    colours[: len(frame.palette), :3] = frame.palette
    colours[:, 3] = 255
    return colours


def rendered(screen: tuple[int, int], frames: list[Frame]) -> Iterator[np.ndarray]:
    """Each frame as shown: RGBA after transparency, over what the disposals have left."""
    width, height = screen
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == PREVIOUS else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = f.samples[: area.shape[0], : area.shape[1]]
        colours = _colours(f)
        if f.transparent is None:
            area[:] = colours[samples]
        else:
            drawn = samples != f.transparent
            area[drawn] = colours[samples[drawn]]
        yield canvas.copy()
        if f.disposal == BACKGROUND:
            area[:] = 0
        elif before is not None:
            canvas = before


def histograms(screen: tuple[int, int], frame: Frame, bins: int = 16) -> list[list[int]]:
    """Drawn pixels in each of ``bins`` equal ranges of red, of green and of blue.

    Transparent pixels and those outside the screen are not drawn.
    """
    width, height = screen
    samples = frame.samples[: max(height - frame.top, 0), : max(width - frame.left, 0)]
    counts = np.bincount(samples.ravel(), minlength=256)
    if frame.transparent is not None:
        counts[frame.transparent] = 0
    places = _colours(frame)[:, :3] // (256 // bins)
    return [np.bincount(p, weights=counts, minlength=bins).astype(np.int64).tolist() for p in places.T]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its UTF-8 with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


STORED = "doc_id bigint, n_bytes bigint, media binary"
READ = (
    "doc_id bigint, n_bytes bigint, media binary, width int, height int, payload binary, "
    "frames array<struct<left:int,top:int,width:int,height:int,delay:int,disposal:int,time:bigint,"
    "shown_sha256:binary,red:array<bigint>,green:array<bigint>,blue:array<bigint>>>, error string"
)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``, the GIF of each row's text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [payload_of(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _ in made], pa.int64()),
                        pa.array([write_gif(p) for _, p in made], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "media"],
                )

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(rows, STORED)


def read(media: DataFrame) -> DataFrame:
    """``media`` with what its GIFs hold: screen size, samples of all frames, and frames.

    ``time`` and ``delay`` are hundredths of a second; ``shown_sha256`` is of the RGBA rows of
    the screen while the frame is shown.
    """

    def timed(screen: tuple[int, int], frames: list[Frame]) -> Iterator[dict]:
        time = 0
        for f, shown in zip(frames, rendered(screen, frames), strict=True):
            red, green, blue = histograms(screen, f)
            yield {
                "left": f.left,
                "top": f.top,
                "width": f.width,
                "height": f.height,
                "delay": f.delay,
                "disposal": f.disposal,
                "time": time,
                "shown_sha256": hashlib.sha256(shown).digest(),
                "red": red,
                "green": green,
                "blue": blue,
            }
            time += f.delay

    def opened(data: bytes | None) -> tuple[tuple, str | None]:
        """((screen, payload, frames), error); one bad file must not stop a table."""
        if data is None:
            return ((None, None), None, None), "no media"
        try:
            screen, shown = read_gif(data)
            return (screen, b"".join([f.samples.tobytes() for f in shown]), list(timed(screen, shown))), None
        except (ValueError, IndexError, struct.error) as error:
            return ((None, None), None, None), str(error)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sizes, payloads, frames, errors = [], [], [], []
                for item in part.column(2):
                    found, error = opened(item.as_py())
                    for column, value in zip((sizes, payloads, frames), found, strict=True):
                        column.append(value)
                    errors.append(error)
                kind = pa.list_(
                    pa.struct(
                        [(n, pa.int32()) for n in ("left", "top", "width", "height", "delay", "disposal")]
                        + [("time", pa.int64()), ("shown_sha256", pa.binary())]
                        + [(n, pa.list_(pa.int64())) for n in ("red", "green", "blue")]
                    )
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([w for w, _ in sizes], pa.int32()),
                        pa.array([h for _, h in sizes], pa.int32()),
                        pa.array(payloads, pa.binary()),
                        pa.array(frames, kind),
                        pa.array(errors, pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "media", "width", "height", "payload", "frames", "error"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, READ)


def op9_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(store(documents(spark, sf_dir)))
    sums = F.aggregate(
        "frames",
        F.array_repeat(F.lit(0).cast("bigint"), 16),
        # Grey pictures: the three channels are equal.
        lambda s, f: F.zip_with(s, f["green"], lambda a, b: a + b),
    )
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -ROW, ROW)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            " ",
            F.concat(F.lit("frames="), F.size("frames")),
            F.concat(F.lit("size="), F.col("width"), F.lit("x"), F.col("height")),
            F.concat(F.lit("ms="), 10 * F.aggregate("frames", F.lit(0), lambda s, f: s + f["delay"])),
            F.concat(F.lit("histogram="), F.array_join(sums.cast("array<string>"), ",")),
        ).alias("feature"),
    )


ship(__name__)
