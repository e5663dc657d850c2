"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of eight bits. Level k of a shard holds chunk k of every id that has one,
a bitmap that says which of them continue on level k + 1, and a rank directory, the number of set
bits before each 512-bit superblock. The token at any place is read by one byte a level: its place
on the next level is the rank of its place here. No block is decoded.

Documents are range-partitioned and sorted by id, so shards follow each other in id order; a shard
carries the ids and starts of its documents and places inside it are relative. The manifest, a
Parquet table written by Spark, names the files of the tasks that were committed: files of lost
attempts are never read. Global starts come from the shard sizes, first by partition, then inside.

Defined results: a null text counts as empty and holds the end id alone; documents with a null id
come first; repeated ids keep a row each, in order of a hash of the text; a document lies in one shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, shared_path, text_of
from .tokenizing import batches, coder_for

DEFAULT_FILE, END_ID = "word_bpe_49k.json", 2
#: Ids after which a shard is closed, and bits of a superblock.
SHARD_IDS, SUPERBLOCK = 1 << 21, 512
MAGIC = b"DAC1"
MANIFEST = "part int, shard int, file string, n_docs bigint, n_ids bigint"


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), SUPERBLOCK), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        levels.append(((rest & 255).astype("u1"), bits, np.concatenate([[0], np.cumsum(counts)]).astype("<u4")))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def pack_shard(doc_ids: np.ndarray, null: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard file: magic, header length, JSON header with the place of each section, sections."""
    sections = {"doc": doc_ids.astype("<i8"), "null": null.astype("u1"), "start": starts.astype("<u8")}
    levels = encode_levels(ids)
    for k, level in enumerate(levels):
        sections |= dict(zip((f"chunk{k}", f"bits{k}", f"rank{k}"), level))
    places, at = {}, 0
    for name, data in sections.items():
        places[name] = [at, data.nbytes]
        at += data.nbytes
    header = json.dumps({"ids": len(ids), "docs": len(doc_ids), "levels": len(levels), "sections": places}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *(d.tobytes() for d in sections.values())])


class Shard:
    """One shard; read(start, length) fetches bytes of the file."""

    def __init__(self, read):
        head = read(0, 8)
        if head[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        length = int.from_bytes(head[4:8], "little")
        self.header, self.base, self.read = json.loads(read(8, length)), 8 + length, read

    def _section(self, name: str, kind: str, start: int = 0, count: int | None = None) -> np.ndarray:
        at, size = self.header["sections"][name]
        width = np.dtype(kind).itemsize
        count = size // width - start if count is None else count
        return np.frombuffer(self.read(self.base + at + start * width, count * width), kind)

    def docs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document ids, which of them are null, and their starts, with the end of the last."""
        return self._section("doc", "<i8"), self._section("null", "u1").astype(bool), np.append(self._section("start", "<u8"), self.header["ids"]).astype("i8")

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i: the directory entry of its superblock and the bits since."""
        block = i // SUPERBLOCK
        before = int(self._section(f"rank{level}", "<u4", block, 1)[0])
        first = block * SUPERBLOCK // 8
        bits = np.unpackbits(self._section(f"bits{level}", "u1", first, (i + 7) // 8 - first), bitorder="little")
        return before + int(bits[: i - block * SUPERBLOCK].sum())

    def token(self, i: int) -> int:
        """The id at place i: one chunk, one bit and one rank a level."""
        value = level = 0
        while True:
            value |= int(self._section(f"chunk{level}", "u1", i, 1)[0]) << (8 * level)
            if not int(self._section(f"bits{level}", "u1", i // 8, 1)[0]) >> (i % 8) & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def tokens(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """The ids at places start to end: on each level one slice, found by one rank."""
        if end <= start:
            return np.zeros(0, "<u4")
        values = self._section(f"chunk{level}", "u1", start, end - start).astype("<u4")
        bits = np.unpackbits(self._section(f"bits{level}", "u1", start // 8, (end + 7) // 8 - start // 8), bitorder="little")
        more = bits[start % 8 : start % 8 + end - start].astype(bool)
        if more.any():
            first = self._rank(level, start)
            values[more] |= self.tokens(first, first + int(more.sum()), level + 1) << np.uint32(8)
        return values


def open_shard(uri: str) -> Shard:
    """A shard in any store that pyarrow's file systems reach, read by ranges."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)
    return Shard(lambda start, length: file.read_at(length, start))


def write_shards(df: DataFrame, name: str = DEFAULT_FILE, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write df in ascending id order; returns the manifest (part, shard, file, n_docs, n_ids, start)."""
    spark = df.sparkSession
    root = path or shared_path(spark, "token-shards")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder)
        number, end, coder = TaskContext.get().partitionId(), np.uint32(end_id).tobytes(), coder_for(name)
        held: list[tuple[int | None, bytes]] = []
        shard = size = 0

        def close() -> pa.RecordBatch:
            file = f"part-{number:06d}-{shard:05d}-{uuid.uuid4().hex}.dac"
            lengths = np.array([len(b) // 4 for _, b in held], "i8")
            data = pack_shard(np.array([i or 0 for i, _ in held], "i8"), np.array([i is None for i, _ in held]), np.cumsum(lengths) - lengths, np.frombuffer(b"".join(b for _, b in held), "<u4"))
            with system.open_output_stream(f"{folder}/{file}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [f"{root}/{file}"], "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([int(lengths.sum())], pa.int64())})

        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a, b in batches(texts):
                for i, coded in zip(ids[a:b], coder.ids(texts[a:b])):
                    held.append((i, coded + end))
                    size += len(coded) // 4 + 1
                    if size >= SHARD_IDS:
                        yield close()
                        held, size, shard = [], 0, shard + 1
        if held:
            yield close()

    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    placed = narrow.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))
    manifest = materialise(placed.mapInArrow(write, MANIFEST), "token-manifest")
    of_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("part_start", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return manifest.join(of_part.drop("ids"), "part").withColumn("start", F.col("part_start") + inside).drop("part_start")


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                shard = open_shard(file)
                docs, null, starts = shard.docs()
                ids = shard.tokens(0, int(starts[-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    dealt = manifest.select("file", "start").repartition(partitions(manifest.sparkSession), "file")
    return dealt.mapInArrow(read, f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
