"""Media columns: archives of losslessly stored samples, read by a data source that plans byte ranges.

A text's UTF-8 bytes, padded with 255 (a byte UTF-8 never holds) to a positive multiple of 576,
become an 8-bit greyscale PNG of 576 samples a row. Tasks write their members one after another
into an archive file; behind them stand a directory of fixed-size entries, a stride table (where
each run of about STRIDE bytes begins) and a footer. Commits carry the strides to a manifest, the one file that the reader's driver
side opens, so planning follows bytes / STRIDE and not the number of members or archives. Each partition is one byte range; its task
fetches runs of members, checks each one, and fetches a failed member again alone, by its offset.

Cases: null and empty texts are one row of padding; a null doc_id stays null; repeated rows give
repeated members; a very long text is one tall image, held whole by one task; an empty table gives
no members; extra columns are ignored. A member that stays unreadable after all retries fails the
task, or with ``on_error="null"`` yields a null image and the reason.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

WIDTH = 576
PAD = 255
ENTRY = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("crc", "<u4")])
FOOTER = struct.Struct("<QQQI")  # members, directory offset, strides, crc of the directory
STRIDE = 16 << 20
READ_BYTES = 2 << 20


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload's bytes as samples of an 8-bit greyscale PNG, 576 a row, no filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples by row of an image as to_png() makes it; raises ValueError on any damage."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Rows, the sum of all samples, and a histogram of 8 equal ranges: integers, equal for equal texts."""
    counts = np.bincount(samples.reshape(-1) >> 5, minlength=8)
    return f"rows={samples.shape[0]};sum={int(samples.sum(dtype=np.uint64))};hist={','.join(map(str, counts.tolist()))}"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    directory: int
    strides: list[int]  # the first member of each


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.stride = options["path"], int(options.get("stride", STRIDE))

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name = f"archive-{part:06d}-{uuid.uuid4().hex}.arc"
        entries, strides, at = [], [], 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for i, j, data, offs in common.slices(batch, "text"):
                    for k in range(i, j):
                        media = to_png(pad(data[offs[k - i] : offs[k - i + 1]].tobytes()))
                        if not strides or at - strides[-1][1] >= self.stride:
                            strides.append((len(entries), at))
                        entries.append((ids[k] is not None, ids[k] or 0, at, len(media), zlib.crc32(media)))
                        out.write(media)
                        at += len(media)
            directory = np.array(entries, ENTRY).tobytes()
            out.write(directory)
            out.write(np.array(strides, "<u8").tobytes())
            out.write(FOOTER.pack(len(entries), at, len(strides), zlib.crc32(directory)))
        return Written(part, name, len(entries), at, [first for first, _ in strides])

    def commit(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        with store.open_output_stream(f"{root}/_archives.json") as out:
            out.write(json.dumps([[m.name, m.rows, m.directory, m.strides] for m in done]).encode())

    def abort(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


@dataclass
class Range(InputPartition):
    name: str
    directory: int
    first: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.retries = options["path"], int(options.get("retries", 3))
        self.null_on_error = options.get("on_error", "fail") == "null"

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{root}/_archives.json") as f:
            archives = json.loads(f.read())
        out = [Range(name, directory, a, b) for name, members, directory, strides in archives for a, b in zip(strides, [*strides[1:], members], strict=True)]
        return out or [Range("", 0, 0, 0)]

    def ranges_of(self, name: str) -> list[Range]:
        """The ranges of one archive, by its own footer and stride table: for an archive whose manifest is lost."""
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{root}/{name}") as f:
            members, directory, strides, _ = FOOTER.unpack(f.read_at(FOOTER.size, f.size() - FOOTER.size))
            table = np.frombuffer(f.read_at(16 * strides, f.size() - FOOTER.size - 16 * strides), "<u8").reshape(-1, 2)
        bounds = [*table[:, 0].tolist(), members]
        return [Range(name, directory, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]

    def member(self, f, entry) -> tuple[bytes | None, str | None]:
        """One member by its offset, again and again until it is whole."""
        why = ""
        for attempt in range(self.retries + 1):
            try:
                media = f.read_at(int(entry["size"]), int(entry["offset"]))
                if len(media) == entry["size"] and zlib.crc32(media) == entry["crc"]:
                    return media, None
                why = "checksum differs"
            except OSError as e:
                why = str(e)
            time.sleep(min(2.0, 0.05 * 2**attempt))
        if not self.null_on_error:
            raise OSError(f"member at {int(entry['offset'])}: {why}")
        return None, why

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.end:
            return
        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{root}/{part.name}") as f:
            own = np.frombuffer(f.read_at(ENTRY.itemsize * (part.end - part.first), part.directory + ENTRY.itemsize * part.first), ENTRY)
            i = 0
            while i < len(own):
                low = int(own["offset"][i])
                j = max(i + 1, int(np.searchsorted(own["offset"], low + READ_BYTES)))
                high = int(own["offset"][j - 1] + own["size"][j - 1])
                try:
                    block = f.read_at(high - low, low)
                except OSError:
                    block = b""
                got = []
                for e in own[i:j]:
                    media = block[int(e["offset"]) - low : int(e["offset"]) - low + int(e["size"])]
                    whole = len(media) == e["size"] and zlib.crc32(media) == e["crc"]
                    got.append((media, None) if whole else self.member(f, e))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own["doc_id"][i:j], pa.int64(), mask=own["known"][i:j] == 0), pa.array([m for m, _ in got], pa.binary()), pa.array([w for _, w in got], pa.string())], schema=schema
                )
                i = j


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakemill_media"

    def schema(self) -> str:
        return "doc_id long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite) -> ArchiveWriter:
        return ArchiveWriter(self.options)


def write(docs: DataFrame, path: str, stride: int = STRIDE) -> None:
    """Store every text as an image member; no shuffle, an archive for each task."""
    spark = docs.sparkSession
    common.prepare(spark)
    spark.dataSource.register(MediaArchive)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.format("lakemill_media").option("stride", str(stride)).mode("append").save(path)


def read(spark: SparkSession, path: str, retries: int = 3, on_error: str = "fail") -> DataFrame:
    """doc_id, media (the PNG file) and error for every member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("lakemill_media").option("retries", str(retries)).option("on_error", on_error).load(path)


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for media in batch.column(1):
            if (raw := media.as_py()) is None:
                rows.append((None,) * 7)
                continue
            samples = from_png(raw)
            payload = samples.tobytes()
            rows.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in _DESCRIBED.split(", ")])


def describe(members: DataFrame) -> DataFrame:
    """Decode each member and compute its digests and features; null where the image is null."""
    return members.select("doc_id", "media").mapInArrow(_describe, _DESCRIBED)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store docs as media, read the stored bytes back, and describe them."""
    spark = docs.sparkSession
    path = common.new_dir(spark, "media")
    write(docs, path)
    return describe(read(spark, path))
