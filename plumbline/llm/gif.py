"""Media columns: payloads as animated GIFs, decoded to timed frames with colour histograms.

The decoder reads any GIF: it undoes LZW code streams, interlacing, local and global palettes,
transparency and disposal, and yields the canvas as each frame shows it. The encoder stores a
payload of samples as palette entries of frames 576 samples wide, under a grey palette.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.llm import _arrow as A
from plumbline.llm import _runtime as R
from plumbline.llm import _words as W

WIDTH, ROWS, DELAY = 576, 64, 10
BINS = 16
#: Largest canvas that is decoded; a larger one is an error of its row, not of the worker.
PIXELS = 1 << 26
DAMAGE = (ValueError, struct.error, IndexError)

FRAME = StructType([StructField("delay_cs", IntegerType()), StructField("left", IntegerType()), StructField("top", IntegerType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("histogram", ArrayType(LongType()))])
ARROW_FRAME = pa.struct([("delay_cs", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])

# code streams


def lzw_codes(samples: bytes, table: list[int]) -> list[int]:
    """The codes, times 256, of 8-bit samples. ``table`` has 2**20 zeros, also on return."""
    out = [256 << 8]
    emit, used = out.append, []
    note = used.append
    free = 258 << 8
    rest = iter(samples)
    node = next(rest) << 8
    for c in rest:
        key = node | c
        child = table[key]
        if child:
            node = child
        else:
            emit(node)
            if free < 1 << 20:
                table[key] = free
                free += 256
                note(key)
            else:
                emit(256 << 8)
                for k in used:
                    table[k] = 0
                used.clear()
                free = 258 << 8
            node = c << 8
    for k in used:
        table[k] = 0
    emit(node)
    emit(257 << 8)
    return out


def widths(count: int, bits: int) -> np.ndarray:
    """Widths of the first codes after a clear code, for samples of ``bits`` bits."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(np.maximum(np.frexp(entries.astype(float))[1], bits + 1), 12)


def code_bytes(codes: np.ndarray) -> bytes:
    """Codes of 8-bit samples as bytes, least significant bit first."""
    clear = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - 1
    since[1:] -= np.repeat(clear, np.diff(np.append(clear, len(codes))))[:-1]
    since[0] = 0
    width = widths(int(since.max()) + 1, 8)[since]
    start = np.cumsum(width) - width
    out = np.zeros((int(start[-1] + width[-1]) + 7) // 8 + 2, np.uint8)
    wide = codes.astype(np.uint32) << (start & 7).astype(np.uint32)
    at = start >> 3
    for k in range(3):  # codes have 9 bits at least, so no two begin in one byte
        out[at + k] |= ((wide >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8)
    return out[:-2].tobytes()


def codes_of(data: bytes, bits: int):
    """Runs of codes from one clear code to the next, without clear and end codes."""
    buffer = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    clear, total = 1 << bits, 8 * len(data)
    table = widths(4097, bits)
    offsets = np.concatenate(([0], np.cumsum(table)))
    at, run, since = 0, [], 0
    while True:
        n = min(4096, len(table) - since) if since < 4096 else 4096
        place, width = (at + offsets[since : since + n] - offsets[since], table[since : since + n]) if since < 4096 else (at + 12 * np.arange(n), np.full(n, 12))
        inside = int(np.searchsorted(place + width, total, "right"))
        place, width = place[:inside], width[:inside]
        if not inside:
            break
        i = place >> 3
        codes = ((buffer[i] | buffer[i + 1] << np.uint32(8) | buffer[i + 2] << np.uint32(16)) >> (place & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            k = int(stop[0])
            run.append(codes[:k])
            yield np.concatenate(run)
            if codes[k] == clear + 1:
                return
            at, run, since = int(place[k] + width[k]), [], 0
        else:
            run.append(codes)
            at, since = int(place[-1] + width[-1]), since + inside
    if run:
        yield np.concatenate(run)


def run_samples(codes: np.ndarray, base: int, most: int) -> np.ndarray:
    """At most ``most`` samples of the codes after a clear code; codes from ``base`` on are entries.

    Entry k is the string of token k and the sample after it, so in the output it is what stands from
    token k's place on. A token's length is one more than that of the token it refers to, and each of
    its samples is a copy of one before: both are followed back by doubling the steps.
    """
    n = len(codes)
    of = codes - base
    if (of >= np.arange(n)).any():
        raise ValueError("a code stream is damaged")
    literal = of < 0
    back, steps = np.append(np.where(literal, n, of), n), np.append(~literal, False).astype(np.int64)
    while (back[:n] < n).any():
        steps += steps[back]
        back = back[back]
    length = steps[:n] + 1
    start = np.cumsum(length) - length
    used = int(np.searchsorted(start, most))  # the tokens that begin within what is wanted
    start, length, literal, codes = start[:used], length[:used], literal[:used], codes[:used]
    source = np.arange(int(length.sum())) - np.repeat(np.where(literal, 0, start - start[np.maximum(of[:used], 0)]), length)
    while True:
        before = source[source]
        if np.array_equal(before, source):
            break
        source = before
    value = np.zeros(len(source), np.uint8)
    value[start[literal]] = codes[literal]
    return value[source[:most]]


def lzw_samples(data: bytes, bits: int, count: int) -> np.ndarray:
    """At most ``count`` samples of a code stream; missing ones are 0."""
    out, at = np.zeros(count, np.uint8), 0
    for run in codes_of(data, bits):
        if len(run) and at < count:
            samples = run_samples(run.astype(np.int64), (1 << bits) + 2, count - at)
            out[at : at + len(samples)] = samples
            at += len(samples)
    return out


# files


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def gif(payload: bytes, table: list[int] | None = None) -> bytes:
    """An animated GIF whose frames show ``payload``, a positive multiple of WIDTH bytes."""
    table = table if table is not None else [0] * (1 << 20)
    rows = len(payload) // WIDTH
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), grey]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        codes = np.array(lzw_codes(part, table), np.int64) >> 8
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", sub_blocks(code_bytes(codes))]
    return b"".join([*out, b"\x3b"])


class Shown(NamedTuple):
    """The canvas while a frame is shown, and the frame's place in it."""

    canvas: np.ndarray
    delay: int
    left: int
    top: int
    width: int
    height: int


def frames(data: bytes):
    """The frames of a GIF in order. A damaged one raises ValueError, struct.error or IndexError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    at = 13

    def palette(flags: int, at: int):
        n = 3 << ((flags & 7) + 1)
        return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n

    def blocks(at: int):
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    common = None
    if flags & 0x80:
        common, at = palette(flags, at)
    back = common[background] if common is not None and background < len(common) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = back
    disposal, delay, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, transparent = (body[0] >> 2) & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, local = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        if w * h > PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        colours, at = palette(local, at + 10) if local & 0x80 else (common, at + 10)
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(-1, 3)
        bits = data[at]
        body, at = blocks(at + 1)
        samples = lzw_samples(body, bits, w * h).reshape(h, w)
        if local & 0x40:  # interlaced: rows 0, 8, ...; 4, 12, ...; 2, 6, ...; 1, 3, ...
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        space = canvas[top : top + h, left : left + w]
        seen = samples[: space.shape[0], : space.shape[1]]
        shown = colours[np.minimum(seen, len(colours) - 1)]
        if transparent is None:
            space[:] = shown
        else:
            space[seen != transparent] = shown[seen != transparent]
        yield Shown(canvas, delay, left, top, w, h)
        if disposal == 2:
            canvas[top : top + h, left : left + w] = back
        elif disposal == 3:
            canvas = before
        disposal, delay, transparent = 0, 0, None


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of BINS levels of red, green and blue."""
    level = pixels.reshape(-1, 3) >> 4
    return np.concatenate([np.bincount(level[:, c], minlength=BINS) for c in range(3)])


# columns


def padded(text: bytes, size: int = WIDTH) -> bytes:
    return text + b"\xff" * (-len(text) % size or (0 if text else size))


def encoded(part, text: str):
    data, off = W.buffers(part.column(text))
    raw, table = data.tobytes(), [0] * (1 << 20)
    media = [gif(padded(raw[a:b]), table) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return [pa.array(np.diff(off)), pa.array(media, pa.binary())]


def store(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with n_bytes, the text's UTF-8 length, and media, a GIF of its padded bytes.

    The bytes are padded with 255 to a positive multiple of 576. A null text counts as empty; all
    other columns but the text pass through, and one named media or n_bytes is replaced.
    """
    return A.extend(documents, text, StructType([StructField("n_bytes", LongType()), StructField("media", BinaryType())]), lambda part: encoded(part, text)).drop(text)


def shown(data: bytes, payloads: bool) -> tuple[list[dict], bytes]:
    """A GIF's frame rows and, where ``payloads``, the red samples of its frames."""
    rows, samples = [], []
    for x in frames(data):
        pixels = x.canvas[x.top : x.top + x.height, x.left : x.left + x.width]
        rows.append({"delay_cs": x.delay, "left": x.left, "top": x.top, "width": x.width, "height": x.height, "histogram": histogram(x.canvas)})
        if payloads:
            samples.append(pixels[:, :, 0].tobytes())
    return rows, b"".join(samples)


def decoded(batches, at: int, payloads: bool, names: list[str]):
    """Frame columns, digests of the samples shown where ``payloads``, and what is wrong."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(at)[i].as_py()
            rows, payload, error = None, b"", None
            try:
                rows, payload = shown(data, payloads) if data is not None else ([], b"")
            except DAMAGE as e:
                error = f"{type(e).__name__}: {e}"
            new = [pa.array([rows], pa.list_(ARROW_FRAME))]
            if payloads:
                digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) if error is None else (None, None, None)
                new += [pa.array([x], kind) for x, kind in zip(digests, (pa.int64(), pa.string(), pa.int64()), strict=True)]
            kept = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*kept.columns, *new, pa.array([error], pa.string())], names=names)


def timed_frames(media: DataFrame, payloads: bool = False) -> DataFrame:
    """``media`` with frames: delay, place and histogram of the canvas (16 levels each of red, green
    and blue) of each frame of the GIF in column media; none for null.

    With ``payloads`` also payload_bytes, payload_sha256 and tail_crc32 of the red samples of all
    frames, one after another. A damaged GIF has null in all of these, and column error says what
    is wrong; it is null for all others. Columns of these names are replaced, in any case.
    """
    R.small_batches(media.sparkSession)
    fields = [StructField("frames", ArrayType(FRAME))]
    if payloads:
        fields += [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType())]
    fields.append(StructField("error", StringType()))
    base = media.select(*[F.col(f"`{c}`") for c in media.columns if c.lower() not in {f.name for f in fields}])
    schema = StructType(base.schema.fields + fields)
    at = base.columns.index("media")
    return base.mapInArrow(lambda batches: decoded(batches, at, payloads, schema.fieldNames()), schema)


def op4_media(spark, sf_dir: str) -> DataFrame:
    """All documents stored as GIFs in a written table, read back and measured."""
    media = R.written(store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "media")
    rows = timed_frames(media, payloads=True)
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 3 * BINS), lambda a, x: F.zip_with(a, x["histogram"], lambda p, q: p + q))
    feature = F.concat(F.lit("frames="), F.size("frames"), F.lit(";delay_cs="), F.aggregate("frames", F.lit(0), lambda a, x: a + x["delay_cs"]), F.lit(";red="), F.array_join(F.slice(total, 1, BINS), ","))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


register_pickle_by_value(sys.modules[__name__])
