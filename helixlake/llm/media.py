"""Media columns: payloads as baseline JPEG files, read back, with DC thumbnails.

A payload of whole units of 192 bytes becomes an image of that many MCUs with three
components, not subsampled.  Each byte is one quantised coefficient (quantiser 1) in zigzag
order: byte b >= 128 is coefficient b, byte b < 128 is coefficient b - 255, so that all
coefficients are of size category 8 and their eight appended bits are the byte itself.
Both Huffman tables hold one code of one bit, for (run 0, size 8), and a restart after
each MCU lets its DC values stand for themselves.  The files are ordinary baseline
sequential JPEG; the reader parses the markers and decodes any file of that kind.
Scans whose tables hold a single code have a fixed stride and are decoded by numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import table, text_or_empty

UNIT = 192
_MCU = 216  # bytes of an MCU: 192 coefficients of 9 bits


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write_jpeg(payload: bytes) -> bytes:
    """A baseline JPEG file that holds ``payload`` (a positive multiple of 192 bytes)."""
    units = len(payload) // UNIT
    wide = min(8191, int(np.ceil(np.sqrt(units))))
    high = -(-units // wide)
    data = np.frombuffer(payload.ljust(wide * high * UNIT, b" "), np.uint8)
    bits = np.zeros((len(data), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
    scan = np.empty((wide * high, _MCU + 2), np.uint8)
    scan[:, :_MCU] = np.packbits(bits).reshape(wide * high, -1)
    scan[:, _MCU] = 0xFF
    scan[:, _MCU + 1] = 0xD0 + np.arange(wide * high) % 8
    if (scan[:, :_MCU] == 0xFF).any():
        coded = b"".join(bytes(r[:_MCU]).replace(b"\xff", b"\xff\0") + bytes(r[_MCU:]) for r in scan)[:-2]
    else:
        coded = scan.tobytes()[:-2]
    head = [
        b"\xff\xd8",
        _segment(0xFE, b"payload " + str(len(payload)).encode()),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + b"\1\x11\0\2\x11\0\3\x11\0"),
        _segment(0xC4, b"\x00\1" + b"\0" * 15 + b"\x08"),
        _segment(0xC4, b"\x10\1" + b"\0" * 15 + b"\x08"),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\3\1\0\2\0\3\0" + b"\0\x3f\0"),
    ]
    return b"".join(head) + coded + b"\xff\xd9"


class Jpeg:
    """The parsed markers of a baseline JPEG file."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, dict[tuple[int, int], int]] = {}
        self.restart, self.comment, at = 0, b"", 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    kind, n = body[0], 128 if body[0] >> 4 else 64
                    self.quant[kind & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(int)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    counts, code, k = body[1:17], 0, 17
                    found: dict[tuple[int, int], int] = {}
                    for length, n in enumerate(counts, 1):
                        for _ in range(n):
                            found[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.tables[body[0]] = found
                    body = body[k:]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline sequential files are read")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                ids = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                self.scan = [(h, v, q, ids[c] >> 4, 16 | ids[c] & 15) for c, h, v, q in self.parts]
                end = data.rfind(b"\xff\xd9")
                self.coded = data[at : end if end >= 0 else len(data)]
                return

    @property
    def mcus(self) -> tuple[int, int]:
        wide, high = max(s[0] for s in self.scan), max(s[1] for s in self.scan)
        return -(-self.height // (8 * high)), -(-self.width // (8 * wide))

    def _single(self) -> bool:
        one = all(list(self.tables[t]) == [(1, 0)] and self.tables[t][1, 0] == 8 for s in self.scan for t in s[3:5])
        return one and self.restart == 1 and len(self.scan) == 3 and all(s[:2] == (1, 1) for s in self.scan)

    def coefficients(self) -> np.ndarray:
        """Quantised coefficients, zigzag order: (MCU, block of the MCU, 64)."""
        high, wide = self.mcus
        raw = np.frombuffer(self.coded + b"\xff\xd0", np.uint8)
        if self._single() and len(raw) == high * wide * (_MCU + 2):
            rows = raw.reshape(high * wide, _MCU + 2)
            bits = np.unpackbits(rows[:, :_MCU].ravel()).reshape(-1, 9)
            if not bits[:, 0].any() and (rows[:, _MCU] == 0xFF).all():
                b = np.packbits(bits[:, 1:].ravel()).astype(np.int16).reshape(high * wide, 3, 64)
                return b - np.where(b >= 128, 0, 255).astype(np.int16)
        return self._any(high * wide)

    def _any(self, units: int) -> np.ndarray:
        """Any baseline scan, code by code."""
        blocks = [(i, s) for i, s in enumerate(self.scan) for _ in range(s[0] * s[1])]
        out = np.zeros((units, len(blocks), 64), np.int16)
        pieces, at, raw = [], 0, self.coded
        for k in range(len(raw) - 1):  # cut at restart markers
            if raw[k] == 0xFF and 0xD0 <= raw[k + 1] <= 0xD7:
                pieces.append(raw[at:k])
                at = k + 2
        pieces.append(raw[at:])
        step = self.restart or units
        for p, piece in enumerate(pieces):
            bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
            at = 0

            def take(n: int) -> int:
                nonlocal at
                value = 0
                for b in bits[at : at + n]:
                    value = value << 1 | b
                at += n
                return value

            def symbol(codes: dict[tuple[int, int], int]) -> int:
                code = 0
                for length in range(1, 17):
                    code = code << 1 | take(1)
                    if (length, code) in codes:
                        return codes[length, code]
                raise ValueError("no such code")

            def signed(n: int) -> int:
                v = take(n)
                return v if not n or v >> (n - 1) else v - (1 << n) + 1

            before = [0] * len(self.scan)
            for unit in range(p * step, min(units, (p + 1) * step)):
                for j, (i, s) in enumerate(blocks):
                    before[i] += signed(symbol(self.tables[s[3]]))
                    out[unit, j, 0] = before[i]
                    k = 1
                    while k < 64:
                        rs = symbol(self.tables[s[4]])
                        if rs == 0:
                            break
                        k += rs >> 4
                        if rs & 15:
                            out[unit, j, k] = signed(rs & 15)
                        k += 1
        return out

    def thumbnail(self, coefficients: np.ndarray) -> np.ndarray:
        """Luminance from the DC terms alone: one pixel for each block of the first component."""
        (h, v, q, *_), (high, wide) = self.scan[0], self.mcus
        dc = coefficients[:, : h * v, 0].astype(float) * self.quant[q][0] / 8 + 128
        grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid are brighter than the mean."""
    rows = np.minimum(np.arange(8) * pixels.shape[0] // 8, pixels.shape[0] - 1)
    columns = np.minimum(np.arange(8) * pixels.shape[1] // 8, pixels.shape[1] - 1)
    cells = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), np.unique(rows), axis=0), np.unique(columns), axis=1)
    sizes = np.outer(np.diff(np.append(np.unique(rows), pixels.shape[0])), np.diff(np.append(np.unique(columns), pixels.shape[1])))
    mean = cells / sizes
    grid = mean[np.searchsorted(np.unique(rows), rows)][:, np.searchsorted(np.unique(columns), columns)]
    return int.from_bytes(np.packbits((grid > grid.mean()).ravel()).tobytes(), "big")


def read_payload(data: bytes) -> tuple[bytes, Jpeg, np.ndarray]:
    """(payload, file, coefficients) of a file of write_jpeg."""
    file = Jpeg(data)
    c = file.coefficients()
    return (c + np.where(c > 0, 0, 255)).astype(np.uint8).tobytes()[: int(file.comment.removeprefix(b"payload "))], file, c


_MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Stores each text as a JPEG file, reads it back and describes it; with the file itself if asked for.

    A null or empty text is one unit of spaces.  feature: width x height and the
    thumbnail's hash.  Every input row gives one row, whether its id is null, repeated or its own;
    other columns are ignored, whatever their names.  No rows in, no rows out.  There is no
    shuffle; a task holds one text at a time as several arrays, about twenty times its bytes.
    """
    names = [c.split()[0] for c in _MEDIA.split(", ")] + (["media"] if keep_media else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                stored = write_jpeg(raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "))
                payload, file, c = read_payload(stored)
                mark = f"{file.width}x{file.height}:{thumbnail_hash(file.thumbnail(c)):016x}"
                out.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), mark, *([stored] if keep_media else [])))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in list(zip(*out, strict=True))[1:]]], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(work, _MEDIA + (", media binary" if keep_media else ""))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


QUERIES = {"op6_media_columns": op6_media_columns}
ORACLE: dict[str, str] = {}
