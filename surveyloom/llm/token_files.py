"""Token ids of documents in binary files: bit planes of fixed blocks, each compressed.

Layout of a file (all integers little-endian):

    magic                   8 bytes
    frames                  each plane of each block, compressed with zstandard
    doc_id, n_ids, given    int64, int64 and uint8 for each document; ``given`` is 0 for a null id
    block sizes             int32 for each plane of each block: bytes of its frame
    block counts            int32 for each block: its ids; int32: its planes
    footer                  int64: documents, blocks, frames, ids; magic

A block has ``block_ids`` ids, the last one of a file fewer.  Plane j of a block holds bit j (or
byte j) of all its ids, so ids below 2**16 need 16 bit planes; planes above the highest bit
set are not stored.  The chunk index (documents and blocks) is enough to read any block
alone.

A table of documents becomes files in ascending doc_id order: a range shuffle deals
documents to tasks, each task sorts its own and streams them into files of about
``file_ids`` ids, under names of its own attempt.  What a task has written is known from its
rows alone, which Spark commits once: the catalogue, one row per file with the number of ids
before it.  Files of lost or repeated attempts are in no catalogue.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.llm import _text as T
from surveyloom.llm._io import dropped, shared_folder, tidy, written

MAGIC = b"IDPLANE1"
#: Ids of a block; a multiple of 8.
BLOCK_IDS = 1 << 14
#: Ids after which a task begins another file.
FILE_IDS = 1 << 23
#: Bytes of ids that leave a reading task together.
OUT_BYTES = 1 << 22
_FOOTER = struct.Struct("<qqqq8s")


def planes_of(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """Bit planes (or byte planes) of some ids, up to the highest one in use."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max(initial=0)).bit_length()
    if not bits:
        return [np.ascontiguousarray(plane).tobytes() for plane in ids.view(np.uint8).reshape(-1, 4).T[: -(-top // 8)]]
    return [np.packbits((ids >> np.uint32(j)) & np.uint32(1) == 1).tobytes() for j in range(top)]


def ids_of(planes: list[bytes], n: int, bits: bool = True) -> np.ndarray:
    """The n ids whose planes these are."""
    out = np.zeros(n, "<u4")
    for j, plane in enumerate(planes):
        values = np.unpackbits(np.frombuffer(plane, np.uint8), count=n) if bits else np.frombuffer(plane, np.uint8)
        out |= values.astype(np.uint32) << np.uint32(j if bits else 8 * j)
    return out


class Writer:
    """One file; documents are added in order and leave memory block by block."""

    def __init__(self, stream, bits: bool, block_ids: int, level: int) -> None:
        import zstandard

        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.frames: list[int] = []
        self.blocks: list[tuple[int, int]] = []
        self.open_: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.open_.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            flat = np.concatenate(self.open_)
            whole = len(flat) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(flat[at : at + self.block_ids])
            self.open_, self.waiting = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = planes_of(ids, self.bits)
        for plane in planes:
            frame = self.packer.compress(plane)
            self.stream.write(frame)
            self.frames.append(len(frame))
        self.blocks.append((len(ids), len(planes)))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.open_))
        self.stream.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.stream.write(np.array(self.lengths, "<i8").tobytes())
        self.stream.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.stream.write(np.array(self.frames, "<i4").tobytes())
        self.stream.write(np.array(self.blocks, "<i4").tobytes())
        self.stream.write(_FOOTER.pack(len(self.docs), len(self.blocks), len(self.frames), self.n_ids, MAGIC))
        self.stream.close()


class Reader:
    """Chunk index of one file, and its blocks by number."""

    def __init__(self, stream, bits: bool) -> None:
        import zstandard

        self.stream, self.bits = stream, bits
        self.unpacker = zstandard.ZstdDecompressor()
        size = stream.size()
        n_docs, n_blocks, n_frames, self.n_ids, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a file of token ids, or not a whole one")
        index = self._at(size - _FOOTER.size - 17 * n_docs - 8 * n_blocks - 4 * n_frames, 17 * n_docs + 8 * n_blocks + 4 * n_frames)
        given = np.frombuffer(index, np.uint8, n_docs, 16 * n_docs)
        self.docs = pa.array(np.frombuffer(index, "<i8", n_docs), mask=given == 0)
        self.lengths = np.frombuffer(index, "<i8", n_docs, 8 * n_docs)
        frames = np.frombuffer(index, "<i4", n_frames, 17 * n_docs)
        self.blocks = np.frombuffer(index, "<i4", 2 * n_blocks, 17 * n_docs + 4 * n_frames).reshape(-1, 2)
        self.edge = len(MAGIC) + np.append(0, np.cumsum(frames, dtype=np.int64))
        self.first_frame = np.append(0, np.cumsum(self.blocks[:, 1], dtype=np.int64))

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def block(self, k: int) -> np.ndarray:
        edge = self.edge[self.first_frame[k] : self.first_frame[k + 1] + 1].tolist()
        if len(edge) < 2:
            return np.zeros(int(self.blocks[k, 0]), "<u4")
        raw = self._at(edge[0], edge[-1] - edge[0])
        return ids_of([self.unpacker.decompress(raw[a - edge[0] : b - edge[0]]) for a, b in zip(edge[:-1], edge[1:], strict=True)], int(self.blocks[k, 0]), self.bits)

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of each document in order; a block is unpacked once."""
        held, k = [np.zeros(0, "<u4")], 0
        have = 0
        for n in self.lengths.tolist():
            while have < n:
                held.append(self.block(k))
                have += len(held[-1])
                k += 1
            flat = np.concatenate(held) if len(held) > 1 else held[0]
            yield flat[:n]
            held, have = [flat[n:]], have - n


def _file_system(folder: str):
    """(file system, path) of a folder that is a plain path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _write(tokenizer_path: str, end_id: int, folder: str, bits: bool, block_ids: int, file_ids: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from surveyloom.llm.packing import ENCODE_BYTES, unit_encoder

        task = TaskContext.get()
        store, path = _file_system(folder)
        encoder, out, done = unit_encoder(tokenizer_path), None, 0
        end = np.array([end_id], np.uint32)

        def row(name: str, w: Writer) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": task.partitionId(), "number": done, "name": name, "n_docs": len(w.docs), "n_ids": w.n_ids}])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for chunk in T.chunks(batch.column("text"), ENCODE_BYTES):
                tokens, bounds = encoder.encode(chunk)
                for i in range(len(chunk)):
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{done:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.ids"
                        out = Writer(store.open_output_stream(f"{path}/{name}", compression=None), bits, block_ids, level)
                    out.add(ids[chunk.first_row + i], np.append(tokens[bounds[i] : bounds[i + 1]], end))
                    if out.n_ids >= file_ids:
                        out.close()
                        yield row(name, out)
                        out, done = None, done + 1
        encoder.forget()
        if out is not None:
            out.close()
            yield row(name, out)

    return run


def _read(folder: str, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(folder)
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as stream:
                    reader = Reader(stream, bits)
                    start = before + np.cumsum(reader.lengths) - reader.lengths
                    first, parts, size = 0, [], 0

                    def leave(first: int, parts: list[bytes], reader=reader, start=start) -> pa.RecordBatch:
                        to = first + len(parts)
                        return pa.RecordBatch.from_arrays([reader.docs[first:to], pa.array(start[first:to]), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

                    for ids in reader.documents():
                        parts.append(ids.tobytes())
                        size += len(parts[-1])
                        if size >= OUT_BYTES:
                            yield leave(first, parts)
                            first, parts, size = first + len(parts), [], 0
                    yield leave(first, parts)

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2, bits: bool = True, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, level: int = 3) -> str:
    """Write the ids of all documents, each with ``end_id`` after it, in ascending doc_id order; returns the folder.

    ``docs`` needs doc_id and text; other columns are ignored.  Null and empty texts are
    ``end_id`` alone.  Null ids come first.  Rows that repeat a doc_id are documents of their
    own, in the order of a hash of their texts; rows that agree in both stand in one task,
    which streams.  An empty table gives an empty catalogue.  ``folder`` must be shared by
    all executors and reachable by a path or a URI; by default a new one beside the checkpoints.
    A task holds one batch, one block and the index of one file; a document must fit a task.
    """
    if block_ids % 8 or block_ids < 8:
        raise ValueError("block_ids must be a multiple of 8")
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    store, path = _file_system(folder)
    store.create_dir(path, recursive=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    files = dealt.mapInArrow(tidy(_write(tokenizer_path, end_id, folder, bits, block_ids, file_ids, level)), "part long, number long, name string, n_docs long, n_ids long")
    files, at = written(files)
    # one row per file, millions of ids each
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("before", before).write.parquet(f"{folder}/catalogue")
    dropped(spark, at)
    return folder


def read_token_files(spark: SparkSession, folder: str, bits: bool = True) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of a folder; a file is a task's work.

    ``start`` is the number of ids before the document in all files, ``ids`` are its ids with
    the end id, as little-endian unsigned 32-bit integers.
    """
    schema = "part long, number long, name string, n_docs long, n_ids long, before long"
    files = spark.read.schema(schema).parquet(f"{folder}/catalogue").select("name", "before")
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    return files.repartition(tasks, "name").mapInArrow(tidy(_read(folder, bits)), "doc_id long, start long, ids binary")
