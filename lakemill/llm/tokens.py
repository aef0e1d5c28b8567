"""Token-ID / binary output: length-delimited records with masked checksums and an offset index.

File format. A data file is a run of frames, one for each text:

    uint64 length | uint32 masked crc32 of those 8 bytes | payload | uint32 masked crc32 of the payload

and a payload is ``uint8 width | uint32 n | zstd(ids as little-endian unsigned integers of that
width)``. The masking is the rotation and constant of the public TFRecord format. Beside each data
file stands an index of 33-byte entries (id present, id, offset, frame bytes, ids), so that a reader
can fetch any frame alone, in any order. A manifest, written last and by the driver, names the
files of the tasks whose rows came back, in order; files of lost or repeated attempts are never read.

Cases: a null text is an empty text and holds the end id only; a null doc_id is kept and comes
first; repeated rows are each written, ties of doc_id in order of text; an empty table gives no
data files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
READ_BYTES = 4 << 20
_CACHE_WORDS = 2_000_000
_JOIN_WORDS = 4000


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: np.ndarray) -> bytes:
    """One record of the format."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    packed = zstandard.ZstdCompressor(level=1, write_content_size=True).compress(ids.astype(f"<u{width}").tobytes())
    payload = struct.pack("<BI", width, len(ids)) + packed
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", mask(zlib.crc32(head))) + payload + struct.pack("<I", mask(zlib.crc32(payload)))


def unframe(buf: memoryview) -> np.ndarray:
    """The ids of one record; raises ValueError if a checksum or a length is wrong."""
    head, crc = bytes(buf[:8]), struct.unpack_from("<I", buf, 8)[0]
    (size,) = struct.unpack("<Q", head)
    if mask(zlib.crc32(head)) != crc or size + 16 != len(buf):
        raise ValueError("damaged frame header")
    payload = buf[12 : 12 + size]
    if mask(zlib.crc32(payload)) != struct.unpack_from("<I", buf, 12 + size)[0]:
        raise ValueError("damaged frame payload")
    width, n = struct.unpack_from("<BI", payload)
    raw = zstandard.ZstdDecompressor().decompress(payload[5:], max_output_size=max(1, n * width))
    return np.frombuffer(raw, f"<u{width}", n).astype("<u4")


# ---------------------------------------------------------------- encoding

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
# The steps of a tokenizer that never look across white space, as its file states them.
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts, each distinct word encoded once.

    The tokenizer's own steps never look across ASCII white space, nor between a letter and a
    full stop or comma that ends a word, and they fold case. So texts are cut there, and the
    library encodes each distinct piece once; a bounded table keeps the results. Texts that
    hold the beginning of an added token go to the library whole, as do all texts if
    the tokenizer file has other steps or patterns than those this rule is proven for.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) or [{}]
        levels = [{k: x.get(k) for k in _LEVEL} for x in rest]
        self.by_word = steps == _STEPS and split == _SPLIT and levels == [_LEVEL] and spec["model"]["type"] == "BPE"
        # a text that holds the first bytes of an added token may hold the token, whose ends follow rules of their own
        self.marks = {x["content"].lower().encode()[:2] for x in spec.get("added_tokens", [])}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def marked(self, folded: bytes) -> bool:
        return any(x in folded for x in self.marks)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode words not seen before; keys are sorted and new."""
        parts, sizes = [], np.zeros(len(words), np.int64)
        for i in range(0, len(words), _JOIN_WORDS):
            block = words[i : i + _JOIN_WORDS]
            got = self.tokenizer.encode(" ".join(block), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in block[:-1])])
            where = np.fromiter((o[0] for o in got.offsets), np.int64, len(got))
            sizes[i : i + len(block)] = np.bincount(np.searchsorted(starts, where, side="right") - 1, minlength=len(block))
            parts.append(np.array(got.ids, np.uint32))
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *parts])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, sizes)

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a slice, each text closed by end_id, and the ends of the texts."""
        n = len(offs) - 1
        raw, low = data.tobytes(), _LOWER[data]
        if not self.by_word or self.marked(low.tobytes()):
            own = [raw[offs[i] : offs[i + 1]] for i in range(n)]
            if not self.by_word or n == 1:
                got = [self.whole(x.decode("utf-8", "replace")) for x in own]
                return np.concatenate([y for x in got for y in (x, [end_id])]).astype(np.uint32), np.cumsum([len(x) + 1 for x in got])
            each = [self.encode(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), end_id) for i in range(n)]
            return np.concatenate([x for x, _ in each]), np.cumsum([len(x) for x, _ in each])
        starts, ends, first = common.spans_of_words(low, offs)
        tail = ends - 1
        cut = (tail > starts) & np.isin(low[tail], (0x2E, 0x2C)) if len(starts) else np.zeros(0, bool)
        cut &= _ASCII_LETTER[low[np.maximum(tail - 1, 0)]] if len(starts) else cut
        extra = np.cumsum(cut)
        # each cut word becomes two pieces: the word, and its last byte
        slot = np.arange(len(starts)) + extra - cut
        total = len(starts) + (int(extra[-1]) if len(extra) else 0)
        s, e = np.zeros(total, np.int64), np.zeros(total, np.int64)
        s[slot], e[slot] = starts, ends - cut
        s[slot[cut] + 1], e[slot[cut] + 1] = tail[cut], ends[cut]
        first = first + np.concatenate([[0], extra])[first]
        hashes = common.hash_spans(low, s, e)
        keys, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > _CACHE_WORDS:
            self.clear()
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[where] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            text = low.tobytes()
            self.learn(keys[new], [text[a:b].decode("utf-8", "replace") for a, b in zip(s[one[new]].tolist(), e[one[new]].tolist(), strict=True)])
        where = np.searchsorted(self.keys, keys)[back]
        size = self.size[where]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[where] - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[first]
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
        return out, bounds[1:] + np.arange(1, n + 1)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- source and sink


_WRITTEN = "part int, name string, n_rows long, n_ids long, size long"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_READ_SQL = "doc_id long, start long, n_tokens long, ids binary"


def _write(path: str, tokenizer: str, end_id: int):
    """A task's rows to a data file and its index; what comes back tells of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        coder, index, at, total = encoder(tokenizer), [], 0, 0
        with store.open_output_stream(f"{root}/{name}.tok") as out:
            for batch in batches:
                ids_of = batch.column(0).to_pylist()
                for i, j, data, offs in common.slices(batch, "text"):
                    ids, ends = coder.encode(data, offs, end_id)
                    begin = 0
                    for k, stop in zip(range(i, j), ends.tolist(), strict=True):
                        record = frame(ids[begin:stop])
                        index.append((ids_of[k] is not None, ids_of[k] or 0, at, len(record), stop - begin))
                        out.write(record)
                        at += len(record)
                        total += stop - begin
                        begin = stop
        if not index:
            store.delete_file(f"{root}/{name}.tok")
            return
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(np.array(index, INDEX).tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_rows": [len(index)], "n_ids": [total], "size": [at]})

    return run


def shards(path: str) -> list[tuple[str, int, int]]:
    """(name, rows, ids before it) of the files of committed tasks, in order."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/_manifest.json") as f:
        files = json.loads(f.read())
    before = np.cumsum([0, *(n for _, _, n, _ in files)]).tolist()
    return [(name, rows, at) for (name, rows, _, _), at in zip(files, before, strict=False)]


def frames(path: str, name: str, before: int, seed: int | None) -> Iterator[pa.RecordBatch]:
    """The records of one file, about READ_BYTES of ids at a time; with a seed in shuffled order, each fetched by its offset."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{name}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    start = before + np.cumsum(index["n"]).astype(np.int64) - index["n"].astype(np.int64)
    order = np.arange(len(index))
    if seed is not None:
        np.random.default_rng((seed, before)).shuffle(order)
    with store.open_input_file(f"{root}/{name}.tok") as f:
        i = 0
        while i < len(order):
            j, room = i + 1, READ_BYTES - int(index["n"][order[i]]) * 4
            while j < len(order) and room >= int(index["n"][order[j]]) * 4:
                room -= int(index["n"][order[j]]) * 4
                j += 1
            got = order[i:j]
            if seed is None:
                low = int(index["offset"][got[0]])
                block = memoryview(f.read_at(int(index["offset"][got[-1]] + index["size"][got[-1]]) - low, low))
                found = [block[int(o) - low : int(o) - low + int(s)] for o, s in zip(index["offset"][got], index["size"][got], strict=True)]
            else:
                found = [memoryview(f.read_at(int(index["size"][k]), int(index["offset"][k]))) for k in got]
            ids = [unframe(x) for x in found]
            if any(len(x) != n for x, n in zip(ids, index["n"][got], strict=True)):
                raise ValueError("index and frames differ")
            yield pa.RecordBatch.from_arrays(
                [pa.array(index["doc_id"][got], pa.int64(), mask=index["known"][got] == 0), pa.array(start[got]), pa.array(index["n"][got].astype(np.int64)), pa.array([x.tobytes() for x in ids], pa.binary())],
                schema=_READ,
            )
            i = j


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every whole text and write it in ascending doc_id order. One shuffle, by range of doc_id; a row for each task comes back."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the beginning of the text parts rows of one doc_id, or of none, without another order
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    done = sorted(rows.mapInArrow(_write(path, tokenizer, end_id), _WRITTEN).collect())
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_manifest.json") as out:
        out.write(json.dumps([[r["name"], r["n_rows"], r["n_ids"], r["size"]] for r in done]).encode())


def read(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32), a task for each file; a seed reads files and frames in shuffled order."""
    files = shards(path)
    if seed is not None:
        files = [files[k] for k in np.random.default_rng(seed).permutation(len(files))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from frames(path, files[k][0], int(files[k][2]), seed)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, _READ_SQL)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs in the format, read the files back, and digest each text's ids."""
    spark = docs.sparkSession
    path = common.new_dir(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
