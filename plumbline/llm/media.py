"""Media columns: texts or any bytes as PNG images in binary columns, and low-frequency cosine hashes of them."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
IDAT = 1 << 16
SIDE, LOW = 32, 8
#: The type-II cosine transform's lowest rows, in integers, so that every machine gets the same bits.
COSINES = np.rint(4096 * np.cos(np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5))).astype(np.int64)


def pad(data: bytes) -> bytes:
    """data with spaces appended up to a positive multiple of an image row."""
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _shifted(rows: np.ndarray, bpp: int):
    """The samples to the left, above, and above to the left; those outside of the image are 0."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, bpp:] = rows[:, :-bpp]
    up[1:] = rows[:-1]
    corner[1:, bpp:] = rows[:-1, :-bpp]
    return left, up, corner


def _half(a, b):
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def _paeth(a, b, c):
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def filtered(rows: np.ndarray, kind: int | None = None) -> np.ndarray:
    """The scanlines with their filter byte, under one of PNG's five filters, or each under the one that leaves it the
    fewest distinct bytes, the first if several do: those deflate packs best."""
    left, up, corner = _shifted(rows, CHANNELS)
    guesses = (np.zeros_like(rows), left, up, _half(left, up), _paeth(left, up, corner))
    if kind is not None:
        return np.concatenate([np.full((len(rows), 1), kind, np.uint8), rows - guesses[kind]], axis=1)
    lines = np.stack([rows - g for g in guesses])
    in_order = np.sort(lines, axis=2)
    kinds = np.argmin((in_order[:, :, 1:] != in_order[:, :, :-1]).sum(axis=2), axis=0).astype(np.uint8)
    return np.concatenate([kinds[:, None], lines[kinds, np.arange(len(rows))]], axis=1)


def unfiltered(lines: np.ndarray, bpp: int) -> np.ndarray:
    """The samples of filtered scanlines.

    Rows without filter or with that of the left are sums along the row, rows with that above take the row above. From
    the first row on that needs both, pixels are taken along diagonals: those whose place and row add up to one
    number depend on earlier diagonals only, and are one step for all rows.
    """
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    height, width = len(rows), rows.shape[1] // bpp
    sub = kinds == 1
    if sub.any():
        rows[sub] = np.cumsum(rows[sub].reshape(sub.sum(), -1, bpp), axis=1, dtype=np.uint8).reshape(sub.sum(), -1)
    mixed = np.flatnonzero(kinds > 2)
    simple = mixed[0] if len(mixed) else height
    for i in np.flatnonzero(kinds[:simple] == 2):
        if i:
            rows[i] += rows[i - 1]
    if simple < height:
        # a border of zeros, or the last simple row, above and to the left
        own, n = kinds[simple:], height - simple
        out = np.zeros((n + 1, width + 1, bpp), np.uint8)
        if simple:
            out[0, 1:] = rows[simple - 1].reshape(width, bpp)
        out[1:, 1:] = rows[simple:].reshape(n, width, bpp)
        for t in range(n + width - 1):
            r = np.arange(max(0, t - width + 1), min(n, t + 1))
            x = t - r
            kind = own[r][:, None]
            left, up, corner = out[r + 1, x], out[r, x + 1], out[r, x]
            guess = np.where(kind == 2, up, np.where(kind == 3, _half(left, up), np.where(kind == 4, _paeth(left, up, corner), 0)))
            out[r + 1, x + 1] += guess.astype(np.uint8)
        rows[simple:] = out[1:, 1:].reshape(n, -1)
    return rows


def encode_png(payload: bytes, filter_kind: int | None = None, level: int = 6) -> bytes:
    """An 8-bit RGB image of WIDTH pixels a row whose samples are the payload, a positive multiple of ROW bytes; without
    filter_kind each row has a filter of its own."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    data = zlib.compress(filtered(rows, filter_kind).tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[k : k + IDAT]) for k in range(0, len(data), IDAT))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """(height, width, channels) samples of an 8-bit image without interlacing; every chunk's checksum is tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, inflate, parts, ended = 8, None, zlib.decompressobj(), [], False
    while not ended:
        if at + 12 > len(png):
            raise ValueError("the PNG ends early")
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if at + 12 + size > len(png) or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if (kind == b"IHDR") != (head is None) or (kind == b"IHDR" and size != 13):
            raise ValueError("a PNG begins with one header")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            try:
                parts.append(inflate.decompress(body))
            except zlib.error as e:
                raise ValueError("damaged samples") from e
        ended = kind == b"IEND"
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("8-bit samples without palette and interlacing only")
    data = b"".join([*parts, inflate.flush()])
    if len(data) != height * (1 + width * channels):
        raise ValueError("the PNG has not the samples that its header says")
    lines = np.frombuffer(data, np.uint8).reshape(height, 1 + width * channels)
    return unfiltered(lines, channels).reshape(height, width, channels)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest frequencies of the image, brought to 32 by 32, are above their median."""
    grey = samples.reshape(len(samples), -1).astype(np.int64)
    h, w = grey.shape
    edge = lambda n: (np.arange(SIDE) * n // SIDE, np.maximum((np.arange(SIDE) + 1) * n // SIDE, np.arange(SIDE) * n // SIDE + 1))
    for axis, n in ((0, h), (1, w)):
        lo, hi = edge(n)
        sums = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
        spread = (hi - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        grey = (sums.take(hi, axis) - sums.take(lo, axis)) * 256 // spread
    low = (COSINES @ grey @ COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_kind: int | None = None, level: int = 6) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded to whole image rows, as a PNG in a binary column.

    Nulls: a null text is an empty one, an image of one row of spaces; a null id is kept. Repeated rows give equal
    images. Very long texts are images with many rows. Empty table: no rows. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                raw = [x.as_py() for x in part.column(1)]
                media = [encode_png(pad(x), filter_kind, level) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary"


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, features) from the stored images of to_media: digests of the samples read back, and phash, the
    8 bytes of cosine_hash. A damaged image raises, since nothing true could be said of it."""

    def of(png):
        samples = decode_png(png)
        data = samples.tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                cols = list(zip(*[of(x.as_py()) for x in part.column(2)], strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *arrays],
                    names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"],
                )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, {FEATURES}")
