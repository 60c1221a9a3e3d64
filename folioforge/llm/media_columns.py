"""Media columns: lossless PNG in binary columns, and low-frequency cosine-transform hashes of what is read back.

A payload of bytes becomes an 8-bit RGB image of 64 pixels a row. Writing and reading are done here with zlib and
numpy: each row's filter is chosen when it is written; chunk framing, CRC tests, inflating and unfiltering of all five
filter types when it is read. The perceptual hash takes the
mean brightness on a 32 x 32 grid, its two-dimensional cosine transform, and the signs of the 8 x 8 lowest frequencies
against their median.

Defined results: a null or empty text is the payload of 192 spaces; equal texts have equal rows; repeated rows stay
repeated; a null ``doc_id`` passes through; an empty table gives no rows. A file whose chunks or checksums are damaged
raises ValueError from ``read_png``. A slice of texts (half a megabyte, or one longer text) is held in memory at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import in_arrow

#: Fixed values of the format: its signature, and the bytes of one row of 64 RGB pixels.
SIGNATURE, ROW_BYTES, CHANNELS = b"\x89PNG\r\n\x1a\n", 192, 3
#: zlib level of the image data.
LEVEL = 1
_CHANNELS_OF = {0: 1, 2: 3, 4: 2, 6: 4}


def payload_of(text: str | None) -> bytes:
    """UTF-8, and spaces up to a positive multiple of a row's bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _near(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Whichever of three neighbours is nearest to left + up - corner; ties go to left, then up."""
    p = left + up - corner
    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def choose_filters(rows: np.ndarray, step: int, tops: np.ndarray) -> np.ndarray:
    """Rows as a PNG holds them: each with the filter whose result has the least sum of absolute (signed) values, and its type in front.

    ``tops`` marks the first row of each image.
    """
    wide = rows.astype(np.int16)
    left, up, corner = np.zeros_like(wide), np.zeros_like(wide), np.zeros_like(wide)
    left[:, step:] = wide[:, :-step]
    up[1:] = wide[:-1]
    up[tops] = 0
    corner[:, step:] = up[:, :-step]
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    for kind, guess in enumerate((np.int16(0), left, up, (left + up) >> 1, _near(left, up, corner))):
        line = (wide - guess).astype(np.uint8)
        cost = np.abs(line.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = cost < least
        out[better, 0], out[better, 1:], least[better] = kind, line[better], cost[better]
    return out


def write_pngs(payloads: list[bytes], width: int = ROW_BYTES // CHANNELS, channels: int = CHANNELS, level: int = LEVEL) -> list[bytes]:
    """8-bit samples, row by row, as a PNG each."""
    stride = width * channels
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, stride)
    ends = np.cumsum([len(x) // stride for x in payloads])
    tops = np.zeros(len(rows), bool)
    tops[[0, *ends[:-1]]] = True
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    out = []
    for lines in np.split(choose_filters(rows, channels, tops), ends[:-1]):
        header = struct.pack(">IIBBBBB", width, len(lines), 8, colour, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b""))
    return out


def write_png(samples: bytes, width: int = ROW_BYTES // CHANNELS, channels: int = CHANNELS, level: int = LEVEL) -> bytes:
    return write_pngs([samples], width, channels, level)[0]


def chunks(png: bytes):
    """(kind, body) of each chunk, whose checksum is tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG: wrong signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("PNG chunk is cut off")
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(png):
            raise ValueError("PNG chunk is cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError(f"PNG chunk {kind!r}: checksum differs")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG has no end chunk")


def unfilter(kinds: np.ndarray, lines: np.ndarray, step: int, tops: np.ndarray | None = None) -> np.ndarray:
    """Undo the row filters: 0 none, 1 left, 2 up, 3 mean of both, 4 the nearest of left, up and corner.

    Rows of several images of one width may stand one after the other, ``tops`` marks the first row of each. A pixel
    needs those to its left, above and between them, so pixels whose row and column in their image add up to the same
    number are done at once, in all images.
    """
    if (kinds > 4).any():
        raise ValueError("PNG has an unknown filter type")
    many, width = len(lines), lines.shape[1] // step
    tops = np.arange(many) == 0 if tops is None else tops
    depth = np.arange(many) - np.maximum.accumulate(np.where(tops, np.arange(many), 0))
    order = np.argsort(depth, kind="stable")
    place = np.empty(many, np.int64)
    place[order] = np.arange(many)
    above = np.where(tops, many, place[np.arange(many) - 1])[order]
    depth, kind = depth[order], kinds[order][:, None]
    first = np.searchsorted(depth, np.arange(int(depth[-1]) + 2 if many else 1))
    given = lines.reshape(many, width, step)[order].astype(np.int16)
    out = np.zeros((many + 1, width + 1, step), np.int16)  # a row of zeros below all, and a column of zeros before all
    for t in range(len(first) - 1 + width - 1 if many else 0):
        a, b = int(first[max(0, t - width + 1)]), int(first[min(t + 1, len(first) - 1)])
        x, mine, k = t - depth[a:b], np.arange(a, b), kind[a:b]
        left, up, corner = out[mine, x], out[above[a:b], x + 1], out[above[a:b], x]
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, _near(left, up, corner), 0))))
        out[mine, x + 1] = (given[mine, x] + guess) & 255
    return out[place, 1:].astype(np.uint8).reshape(lines.shape)


def _lines_of(png: bytes) -> tuple[np.ndarray, int]:
    """(rows with their filter types in front, channels) of an 8-bit PNG without interlacing."""
    header, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if header is None or header[2] != 8 or header[3] not in _CHANNELS_OF or any(header[4:]):
        raise ValueError("PNG of a kind that is not read here")
    width, height, channels = header[0], header[1], _CHANNELS_OF[header[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if lines.size != height * (width * channels + 1):
        raise ValueError("PNG data has the wrong size")
    return lines.reshape(height, -1), channels


def read_pngs(images: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(rows of samples, channels) of each image; images of one shape are unfiltered together."""
    found = [_lines_of(x) for x in images]
    out: list = [None] * len(found)
    shapes = {(lines.shape[1], channels) for lines, channels in found}
    for shape in shapes:
        mine = [i for i, (lines, channels) in enumerate(found) if (lines.shape[1], channels) == shape]
        lines = np.concatenate([found[i][0] for i in mine])
        ends = np.cumsum([len(found[i][0]) for i in mine])
        tops = np.zeros(len(lines), bool)
        tops[[0, *ends[:-1]]] = True
        for i, rows in zip(mine, np.split(unfilter(lines[:, 0], lines[:, 1:], shape[1], tops), ends[:-1])):
            out[i] = rows, shape[1]
    return out


def read_png(png: bytes) -> tuple[np.ndarray, int]:
    return read_pngs([png])[0]


_GRID = 32
_COSINE = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(_GRID)[None, :] + 1) / (2 * _GRID))


def _averages(values: np.ndarray, axis: int) -> np.ndarray:
    """Means over _GRID equal spans of an axis; short axes are repeated first."""
    n = values.shape[axis]
    if n < _GRID:
        values, n = np.repeat(values, -(-_GRID // n), axis=axis), n * -(-_GRID // n)
    at = np.arange(_GRID) * n // _GRID
    return np.add.reduceat(values, at, axis=axis) / np.diff([*at, n]).reshape([-1 if i == axis else 1 for i in range(values.ndim)])


def cosine_hash(rows: np.ndarray, channels: int) -> str:
    """16 hex digits: signs of the low frequencies of brightness, against their median."""
    grey = rows.reshape(len(rows), -1, channels).sum(axis=2, dtype=np.float64)
    low = _COSINE @ _averages(_averages(grey, 0), 1) @ _COSINE.T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def with_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media, payload_sha256, tail_crc32, ...): each text as a PNG in a binary column, read back and measured."""

    def step(part: pa.RecordBatch) -> dict:
        texts = part.column(1).to_pylist()
        out = {name: [] for name in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
        written = write_pngs([payload_of(value) for value in texts])
        for value, media, (rows, channels) in zip(texts, written, read_pngs(written)):
            back = rows.tobytes()
            for name, x in (("n_bytes", len((value or "").encode())), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", cosine_hash(rows, channels)), ("media", media)):
                out[name].append(x)
        return {key: part.column(0)} | out

    return in_arrow(df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")), step, f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
