"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with a checksum for each frame.

Layout of a shard (the public zstd seekable format): frames of FRAME ids each (little-endian, 16 bits where the vocabulary fits, else
32), one skippable frame with the document index, one skippable frame with the seek table: for each frame its compressed size, its
decompressed size and the low 32 bits of the XXH64 of its content. Frames don't depend on each other, and the index gives each
document's place, so a reader decompresses only the frames that hold the documents it wants, however long a document is.

Documents are range-partitioned and sorted by doc_id, so shards follow each other in ascending doc_id order; a task writes its shard
frame by frame under a name of its attempt and renames it at the end, so a repeated task replaces it by the same bytes. Files go to
a folder that every executor reaches, by pyarrow's file systems. What reaches the driver is one manifest row a shard.

Defined results: null and empty texts are encoded as the end id alone; a null doc_id comes first; rows that repeat a doc_id are
written one after the other, by the hash of their text; an empty table makes no shards and gives no rows; extra columns are not stored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written
from .wordhash import IS_SPACE, slices

FRAME, LEVEL = 65_536, 3
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 2
#: Parts whose ids a worker keeps, parts encoded at a time, and about how many bytes of text are worked at a time.
_PIECES, _BATCH, _BYTES = 1_000_000, 1_000, 12_000_000


#: White space outside ASCII (the Unicode property White_Space).
_WIDE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Classes of bytes: 0 other, 1 letters, 2 digits, 3 marks (not the apostrophe, which may open a contraction).
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[x for x in range(33, 127) if not _CLASS[x] and x != 39]] = 3


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at, at + 1, .. at + size - 1 for each size, one after the other."""
    end = np.cumsum(size, dtype=np.int64)
    out = np.ones(end[-1] if len(end) else 0, dtype=np.int32)
    some = size > 0
    at, size, end = at[some], size[some], end[some]
    out[end - size] = at - np.append(1, at[:-1] + size[:-1]) + 1
    if len(out):
        out[0] = at[0]
    return np.cumsum(out, dtype=np.int32)


def part_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte starts of the parts of texts: places at which the byte-level pre-tokenizer always ends a piece, so that parts can be encoded
    one by one. They are the starts of texts; the first and, before other text, the last character of each run of white space; what
    follows a run that doesn't end in a space; and changes of class between ASCII letters, digits and marks."""
    n, kind, space = len(raw), _CLASS[raw], IS_SPACE[raw]
    cut, edge = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before, after = space[:-1] & ~edge[1:n], space[1:] & ~edge[1:n]  # the neighbour is white space of the same text
    first, last = space.copy(), space & ~edge[1:]
    first[1:] &= ~before
    last[:-1] &= ~after
    cut[:n] = edge[:n] | first | last
    cut[1:] |= last & (raw != 32)
    cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level BPE with its own regular expression, without a normalizer, is worked by parts: Arrow finds the distinct parts of a batch, the
    library encodes those that aren't known yet (up to _PIECES are kept, then it starts anew), and numpy gathers the ids. Whether a tokenizer is of
    that kind is read from its own configuration; others, and texts with an added token or white space outside ASCII, are encoded whole.
    """

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        conf = json.loads(self.tokenizer.to_str())
        split, model = conf["pre_tokenizer"] or {}, conf["model"]
        self.by_parts = (
            split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and model.get("type") == "BPE" and not model.get("dropout") and not any(conf.get(k) for k in ("normalizer", "truncation", "padding"))
        )
        self.whole = "|".join([_WIDE, *(re.sub(r"([^\w])", r"\\\1", x["content"]) for x in conf["added_tokens"])])
        line = self._ids("\n")
        self.line, self.by_parts = int(line[0]), self.by_parts and len(line) == 1
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _forget(self) -> None:
        """Keeps the parts that more batches held than the median part, at most half of them."""
        if not hasattr(self, "known"):
            self.known, self.flat = pa.array([], pa.large_string()), np.empty(1 << 16, dtype=self.dtype)
            self.at, self.size, self.hits, self.used = *(np.empty(0, dtype=np.int32) for _ in range(3)), 0
            return
        keep = np.flatnonzero(self.hits > (np.median(self.hits) if len(self.hits) else 0))
        ids = self.flat[_spread(self.at[keep], self.size[keep])]
        self.known, self.size, self.hits = self.known.take(pa.array(keep)), self.size[keep], self.hits[keep]
        self.at, self.used, self.flat = np.cumsum(self.size, dtype=np.int32) - self.size, len(ids), ids

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has. The parts (without white space after the first character) are strung together by line
        feeds, which are pieces of their own, so that the library is called for many at a time."""
        ids, size = [], []
        for lo in range(0, len(parts), _BATCH):
            group = parts[lo : lo + _BATCH]
            got = self._ids("\n".join(group))
            cut = np.flatnonzero(got == self.line)
            if len(cut) == len(group) - 1:
                ids.append(np.delete(got, cut))
                size.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
            else:
                each = [self._ids(p) for p in group]
                ids.extend(each)
                size.append(np.array(list(map(len, each))))
        return np.concatenate([np.empty(0, dtype=self.dtype), *ids]), np.concatenate([np.empty(0, dtype=np.int64), *size])

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Adds the parts to those known and returns their places."""
        blank = pc.match_substring_regex(parts, r"\n|\s$|\s\s").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~blank), np.flatnonzero(blank)])
        parts, plain = parts.take(pa.array(order)), len(parts) - int(blank.sum())
        ids, size = self._encode_parts(parts.slice(0, plain).to_pylist())
        rest = [self._ids(p) for p in parts.slice(plain).to_pylist()]
        ids, size = np.concatenate([ids, *rest]), np.concatenate([size, np.array(list(map(len, rest)), dtype=np.int64)])
        at = self.used + np.cumsum(size) - size
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + 2 * len(ids), dtype=self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(self.known), len(self.known) + len(order), dtype=np.int32)
        self.known = pa.concat_arrays([self.known, parts])
        self.at, self.size, self.hits = (np.concatenate([x, y.astype(np.int32)]) for x, y in ((self.at, at), (self.size, size), (self.hits, np.zeros_like(at))))
        return place

    def _places(self, parts: pa.Array) -> np.ndarray:
        at = pc.index_in(parts, value_set=self.known)
        if len(self.known) + at.null_count > _PIECES:
            self._forget()
            at = pc.index_in(parts, value_set=self.known)
        new = at.is_null()
        place = at.fill_null(0).to_numpy().copy()
        if at.null_count:
            place[new.to_numpy(zero_copy_only=False)] = self._learn(parts.filter(new))
        self.hits[place] += 1
        return place

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows one after the other, where each row's ids start and the last one's end)."""
        for lo, hi, raw, off in slices(texts, _BYTES):
            odd = pc.match_substring_regex(texts.slice(lo, hi - lo), self.whole).fill_null(False).to_numpy(zero_copy_only=False) if self.by_parts else np.ones(hi - lo, dtype=bool)
            starts = part_starts(raw, off)
            if self.by_parts and len(starts):
                bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
                parts = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(raw)).dictionary_encode()
                place = self._places(parts.dictionary)[parts.indices.to_numpy()]
                size = self.size[place]
                ids = self.flat[_spread(self.at[place], size)]
                row = np.append(0, np.cumsum(size, dtype=np.int64))[np.searchsorted(starts, off)]
            else:
                ids, row = np.empty(0, dtype=self.dtype), np.zeros(hi - lo + 1, dtype=np.int64)
            if odd.any():
                each = [self._ids(texts[lo + i].as_py() or "") if odd[i] else ids[row[i] : row[i + 1]] for i in range(hi - lo)]
                ids, row = np.concatenate(each), np.cumsum([0, *map(len, each)])
            yield lo, ids, row

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed."""
        out = []
        for _, ids, row in self.batches(pa.array(texts, pa.large_string())):
            raw, width = ids.tobytes(), self.dtype.itemsize
            out.extend(raw[a * width : b * width] for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True))
        return out


def token_counts(tokenizer: str):
    """From rows (key, text) to rows (key, n): how many ids each text has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            n = [np.diff(row) for _, _, row in encoder.batches(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.empty(0, dtype=np.int64))], [batch.schema.names[0], "n"])

    return of


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class Shard:
    """Writes one shard as documents come."""

    def __init__(self, out, dtype: str):
        self.out, self.dtype, self.width = out, dtype, np.dtype(dtype).itemsize
        self.buffer, self.table, self.ids, self.lengths = bytearray(), [], [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // self.width)
        self.buffer += ids
        full = FRAME * self.width
        while len(self.buffer) >= full:
            self._frame(bytes(self.buffer[:full]))
            del self.buffer[:full]

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        known = np.array([x is not None for x in self.ids], dtype=np.uint8)
        head = json.dumps({"dtype": self.dtype, "frame": FRAME, "docs": len(self.ids)}).encode()
        body = self.zstd.compress(known.tobytes() + np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + np.array(self.lengths, dtype="<i8").tobytes())
        index = struct.pack("<I", len(head)) + head + body
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.table.append((8 + len(index), 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))


class ShardReader:
    """Reads a shard's seek table and index, then any documents by decompressing only their frames."""

    def __init__(self, path: str):
        fs, p = _open(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        self.table = [struct.unpack_from("<III", self.file.read_at(12 * frames, size - 9 - 12 * frames), 12 * k) for k in range(frames)]
        self.at = np.concatenate([[0], np.cumsum([x[0] for x in self.table])])
        packed, _, check = self.table.pop()
        index = self.file.read_at(packed, int(self.at[-2]))[8:]
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != check:
            raise ValueError(f"{path}: the index is damaged")
        n = struct.unpack_from("<I", index)[0]
        meta = json.loads(index[4 : 4 + n])
        body, docs = zstandard.ZstdDecompressor().decompress(index[4 + n :]), meta["docs"]
        self.dtype, self.frame_ids, self.path = np.dtype(meta["dtype"]), meta["frame"], path
        known, ids, self.lengths = (np.frombuffer(body[a:b], dtype=t) for a, b, t in ((0, docs, "u1"), (docs, 9 * docs, "<i8"), (9 * docs, 17 * docs, "<i8")))
        self.doc_ids = [int(x) if k else None for k, x in zip(known, ids, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.table[k]
        content = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.at[k])), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return np.frombuffer(content, dtype=self.dtype)

    def parts(self, i: int) -> Iterator[np.ndarray]:
        """The ids of document i, frame by frame."""
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        while a < b:
            k = a // self.frame_ids
            if getattr(self, "_held", (None,))[0] != k:
                self._held = (k, self.frame(k))
            end = min(b, (k + 1) * self.frame_ids)
            yield self._held[1][a - k * self.frame_ids : end - k * self.frame_ids]
            a = end

    def document(self, i: int) -> np.ndarray:
        return np.concatenate([np.empty(0, dtype=self.dtype), *self.parts(i)])


def _write(folder: str, tokenizer: str, end_id: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, encoder = TaskContext.get(), None, Encoder.of(tokenizer)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        fs, root = _open(folder)
        name = f"{root}/shard-{task.partitionId():06d}.zst"
        part = f"{name}.{task.taskAttemptId()}"
        for batch in batches:
            if shard is None and batch.num_rows:
                out = fs.open_output_stream(part)
                shard = Shard(out, encoder.dtype.str)
            docs = batch.column(0).to_pylist()
            for first, ids, row in encoder.batches(batch.column(1)):
                raw, at = ids.tobytes(), (row * encoder.dtype.itemsize).tolist()
                for k in range(len(at) - 1):
                    shard.add(docs[first + k], raw[at[k] : at[k + 1]] + end)
        if shard is not None:
            shard.close()
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/shard-{task.partitionId():06d}.zst"], "docs": [len(shard.ids)], "ids": [sum(shard.lengths)]})

    return of


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the shards under `folder` and returns their manifest: shard, path, docs, ids."""
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return written(rows.mapInArrow(_write(folder, tokenizer, end_id), "shard long, path string, docs long, ids long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            reader = ShardReader(path)
            for lo in range(0, len(reader.doc_ids), 5000):
                rows = range(lo, min(lo + 5000, len(reader.doc_ids)))
                crcs = []
                for i in rows:
                    crc = 0
                    for ids in reader.parts(i):
                        crc = zlib.crc32(ids.astype("<u4"), crc)
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([reader.doc_ids[i] for i in rows], pa.int64()), pa.array(base + reader.starts[rows.start : rows.stop]), pa.array(reader.lengths[rows.start : rows.stop]), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards, base = [], 0
    for r in manifest.orderBy("shard").collect():  # one row a shard
        shards.append((r["path"], base))
        base += r["ids"]
    table = spark.createDataFrame(shards, "path string, base long").repartition(max(1, len(shards)))
    return table.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files to the shared folder and reports on what they hold."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, write_token_files(docs, folder, tokenizer, end_id))
