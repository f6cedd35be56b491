"""Token ids in files of independent zstandard frames with a seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit numbers),
then a frame with the documents' ids and id counts, then a skippable frame with the seek
table: compressed size, decompressed size and checksum of each frame, and a footer with
the number of frames.  This is the public seekable format, so a reader opens the end of
a file, finds the frames it wants and decompresses only those.

Documents are dealt by range of id, so files follow one another in ascending order of
id.  A task writes its file under a name of its own; only files named in the manifest,
which is stored, count, so a task that is run again does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.llm.common import shared_path, stored, table, text_or_empty
from helixlake.llm.encoding import chunks, encoder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
_MANIFEST = "path string, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint"


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The trailing skippable frame for (compressed, decompressed, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *e) for e in entries)
    return struct.pack("<II", SKIPPABLE, len(body) + 9) + body + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)


class FrameWriter:
    """Writes documents to one file; close() returns the number of documents and ids."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=level).compress
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.pack(data)
        self.stream.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self._frame(ids.astype("<u4").tobytes())
        self.docs.append((doc_id, len(ids)))

    def close(self) -> tuple[int, int]:
        self._frame(np.array(self.docs, "<i8").tobytes())
        self.stream.write(seek_table(self.entries))
        return len(self.docs), sum(n for _, n in self.docs)


class FrameReader:
    """Reads documents of a file that was opened for random access."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums at the end")
        raw = np.frombuffer(file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.packed, self.size, self.check = raw[:, 0], raw[:, 1], raw[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        table = np.frombuffer(self.frames(count - 1, count)[0], "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = table[:, 0], table[:, 1]

    def frames(self, begin: int, end: int) -> list[bytes]:
        """Frames begin .. end - 1, decompressed and checked, by one read."""
        import xxhash

        raw, base, out = self.file.read_at(int(self.at[end] - self.at[begin]), int(self.at[begin])), int(self.at[begin]), []
        for k in range(begin, end):
            part = raw[int(self.at[k]) - base : int(self.at[k + 1]) - base]
            data = self.unpack(part, max_output_size=int(self.size[k]))
            if len(data) != self.size[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.check[k]:
                raise ValueError(f"frame {k} is damaged")
            out.append(data)
        return out

    def ids(self, doc_id: int) -> np.ndarray:
        """The ids of one document; only its frame is decompressed."""
        k = int(np.searchsorted(self.doc_ids, doc_id))
        if k == len(self.doc_ids) or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return np.frombuffer(self.frames(k, k + 1)[0], "<u4")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id", drops_space: bool = False, level: int = 3) -> DataFrame:
    """Encodes and writes all documents; returns the stored manifest, a row per file.

    Null texts count as empty (one end id).  Rows without an id come first, under NO_ID;
    rows that repeat an id follow one another.  An empty table gives an empty manifest.
    Further columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = writer = path = first = last = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                tokens, sizes = encoder(vocabulary, drops_space).batch(texts[begin:end], end_id)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(begin, end):
                    if writer is None:
                        system, at = _open(folder)
                        system.create_dir(at, recursive=True)
                        path, first = f"{folder}/{uuid.uuid4().hex}.zst", ids[k]
                        stream = system.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}", compression=None)
                        writer = FrameWriter(stream, level)
                    last = ids[k]
                    writer.add(last, tokens[cuts[k - begin] : cuts[k - begin + 1]])
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([v], pa.int64()) for v in (first, last, n_docs, n_ids))], ["path", "first_id", "last_id", "n_docs", "n_ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("t"))
    rows = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    return stored(rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(write, _MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads all files of a manifest: doc_id, start, n_tokens, ids_crc32; start counts the ids of all documents before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _open(path)
                with system.open_input_file(at) as file:
                    reader = FrameReader(file)
                    starts = base + np.concatenate([[0], np.cumsum(reader.lengths)])
                    for k in range(0, len(reader.doc_ids), 256):
                        end = min(k + 256, len(reader.doc_ids))
                        sums = [zlib.crc32(x) for x in reader.frames(k, end)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (reader.doc_ids[k:end], starts[k:end], reader.lengths[k:end], sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    order = W.partitionBy(F.lit(1)).orderBy("first_id", "last_id", "path").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long").alias("base"))  # a row per file
    files = max(1, manifest.count())
    found = based.repartition(files, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(manifest)


QUERIES = {"op4_token_files": op4_token_files}
ORACLE: dict[str, str] = {}
