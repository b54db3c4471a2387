"""Token ids in files of fixed-width bit packing, with block offsets for random access.

A file is: magic; blocks of ``BLOCK`` ids, each id in the fewest bits that hold the vocabulary and
each block padded to whole bytes; the byte offset of every block; the doc_id and the first token
(within the file) of every document; a trailer of fixed size that says where these tables begin.
All numbers are little-endian, ids within a block are big-endian bit fields.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.files import new_file, open_fs
from tidelog.llm.tokens import encoder
from tidelog.stage import Stage

MAGIC, BLOCK, TRAILER = b"TLBITS01", 4096, struct.Struct("<QQQQI8s")
MANIFEST = "part int, no int, path string, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_NULL = np.iinfo(np.int64).min


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype("<u4")
    narrow = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = narrow
    return np.packbits(wide, axis=1).reshape(-1).view(">u4").astype("<u4")


class BitWriter:
    """Packs ids into a stream; keeps at most a block of them."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.at, self.tokens = stream, bits, len(MAGIC), 0
        self.keep: list[np.ndarray] = []
        self.kept, self.blocks, self.keys, self.starts = 0, [], [], []
        stream.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(_NULL if key is None else key)
        self.starts.append(self.tokens)
        self.tokens += len(ids)
        self.keep.append(ids)
        self.kept += len(ids)
        if self.kept >= BLOCK:
            ids = np.concatenate(self.keep)
            whole = self.kept // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i : i + BLOCK])
            self.keep, self.kept = [ids[whole:].copy()], self.kept - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack_bits(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.kept:
            self._block(np.concatenate(self.keep))
        for table in (self.blocks, self.keys, self.starts):
            self.stream.write(np.array(table, "<i8").tobytes())
        self.stream.write(TRAILER.pack(self.at, len(self.blocks), len(self.keys), self.tokens, self.bits, MAGIC))


class BitReader:
    """Reads documents of a file by their position, from the blocks that hold them."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - TRAILER.size)
        at, blocks, docs, self.tokens, self.bits, magic = TRAILER.unpack(file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        self.end = at
        file.seek(at)
        table = lambda n: np.frombuffer(file.read(8 * n), "<i8")
        self.blocks, self.keys, self.starts = table(blocks), table(docs), table(docs)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from the file's token ``start`` on."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        stop = int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        self.file.seek(int(self.blocks[first]))
        data = self.file.read(stop - int(self.blocks[first]))
        count = min(self.tokens, (last + 1) * BLOCK) - first * BLOCK
        per = BLOCK * self.bits // 8  # BLOCK is a multiple of 8, so whole blocks join without gaps
        assert len(data) >= (count // BLOCK) * per
        return unpack_bits(data, count, self.bits)[start - first * BLOCK :][:n]

    def doc(self, i: int) -> np.ndarray:
        end = self.starts[i + 1] if i + 1 < len(self.starts) else self.tokens
        return self.ids(int(self.starts[i]), int(end - self.starts[i]))


def write_token_files(docs: DataFrame, tokenizer: str, stage: Stage, end_id: int = 0, roll: int = 1 << 26, roll_docs: int = 1 << 20) -> DataFrame:
    """Encode documents and write them in ascending doc_id order, files for each range of doc_ids.

    A file ends with the document that brings it to ``roll`` tokens or ``roll_docs`` documents, so
    neither files nor their tables grow with the data. Returns the manifest (part, no, path, docs,
    tokens), written as a table: one row a file, in ascending order of ``part`` and ``no``. Null
    texts count as empty; a document always has its ``end_id``. A null doc_id comes first; rows of
    equal doc_id are all kept, in the order of their texts.
    """
    folder = stage.path("tokens")
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in MANIFEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        bits = bits_for(max(enc.tokenizer.get_vocab_size(), end_id + 1))

        def coded() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                for at in range(0, len(keys), 256):
                    yield from zip(keys[at : at + 256], enc.encode(batch.column("text").slice(at, 256).to_pylist()), strict=True)

        rows, no = coded(), 0
        row = next(rows, None)
        while row is not None:
            with new_file(folder, f"ids-{no}") as (stream, path):
                writer = BitWriter(stream, bits)
                while row is not None and writer.tokens < roll and len(writer.keys) < roll_docs:
                    writer.add(row[0], np.concatenate([row[1], end]))
                    row = next(rows, None)
                writer.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "no": no, "path": path, "docs": len(writer.keys), "tokens": writer.tokens}], schema)
            no += 1

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage.save(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), n_tokens, crc32 of its ids.

    Only the manifest, a row for each file of some 64 million tokens, is summed up in one task.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, local = open_fs(path)
                with store.open_input_file(local) as file:
                    reader = BitReader(file)
                    n = len(reader.keys)
                    for at in range(0, n, 1024):
                        # the documents' ids at once, then cut: one read and one unpacking
                        to = min(n, at + 1024)
                        ends = np.append(reader.starts[at + 1 : to], reader.starts[to] if to < n else reader.tokens)
                        first = int(reader.starts[at])
                        crc = []
                        if ends[-1] - first <= 1 << 22:
                            ids = reader.ids(first, int(ends[-1]) - first)
                            crc = [zlib.crc32(ids[s - first : e - first].tobytes()) for s, e in zip(reader.starts[at:to].tolist(), ends.tolist(), strict=True)]
                        else:
                            crc = [zlib.crc32(reader.doc(i).tobytes()) for i in range(at, to)]
                        keys = pa.array(reader.keys[at:to], mask=reader.keys[at:to] == _NULL)
                        yield pa.RecordBatch.from_arrays([keys, pa.array(reader.starts[at:to] + start), pa.array(ends - reader.starts[at:to]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, manifest.count()), "path").mapInArrow(run, ROWS)
