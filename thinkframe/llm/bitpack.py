"""Operator 6: token ids in a fixed-width bit-packed file format.

A file holds the ids of consecutive documents. Every id takes the same
``width`` bits, the fewest that hold the vocabulary's largest id. Layout, little-endian::

    magic 8 bytes "BITPACK1"
    uint32 width, uint32 ids a block, uint64 ids, uint64 documents, uint64 blocks
    blocks: each ``width`` * ids-a-block / 64 words of 64 bits; the last one padded with zeros
    uint64 byte offset of every block
    int64 doc_id of every document, the least int64 for a null one
    uint64 first id of every document, and one past the last

Lane i of a block holds ids i, i + L, i + 2L, ... (L = ids-a-block / 64) so that 64 shifts
on whole arrays unpack a block, and any block can be read alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import nfc, partitions_for, shared_path, ship_package, staged
from .tokens import default_vocabulary, encoder

MAGIC = b"BITPACK1"
BLOCK_IDS = 4096
END_ID = 0
NO_ID = -(2**63)
_HEAD = struct.Struct("<8sIIQQQ")


def id_bits(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int, block: int = BLOCK_IDS) -> np.ndarray:
    """uint64 words, block by block; ``block`` is a multiple of 64."""
    lanes = block // 64
    blocks = -(-len(ids) // block)
    padded = np.zeros(blocks * block, dtype=np.uint64)
    padded[:len(ids)] = ids
    v = padded.reshape(blocks, 64, lanes)
    words = np.zeros((blocks, width, lanes), dtype=np.uint64)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        words[:, at] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= v[:, i] >> np.uint64(64 - shift)
    return words.reshape(blocks, width * lanes)


def unpack_ids(words: np.ndarray, width: int, block: int = BLOCK_IDS) -> np.ndarray:
    """Ids of whole blocks (uint32), padding included."""
    lanes, mask = block // 64, np.uint64((1 << width) - 1)
    w = words.reshape(-1, width, lanes)
    out = np.empty((len(w), 64, lanes), dtype=np.uint32)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        v = w[:, at] >> np.uint64(shift)
        if shift + width > 64:
            v = v | w[:, at + 1] << np.uint64(64 - shift)
        out[:, i] = v & mask
    return out.reshape(-1)


def file_bytes(doc_ids: list[int], ids: list[np.ndarray], width: int, block: int = BLOCK_IDS) -> bytes:
    """A whole file for documents in the given order."""
    sizes = np.array([0, *map(len, ids)], dtype=np.uint64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words = pack_ids(flat, width, block)
    head = _HEAD.pack(MAGIC, width, block, len(flat), len(doc_ids), len(words))
    step = width * block // 8
    places = np.arange(len(words), dtype="<u8") * np.uint64(step) + np.uint64(_HEAD.size)
    return b"".join([head, words.astype("<u8").tobytes(), places.tobytes(), np.array(doc_ids, dtype="<i8").tobytes(),
                     np.cumsum(sizes).astype("<u8").tobytes()])


class PackedFile:
    """Reads a file's bytes; ``ids(a, b)`` unpacks only the blocks that hold that range."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.n_ids, n_docs, n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a bit-packed id file")
        at = _HEAD.size + n_blocks * self.width * self.block // 8
        self.data = data
        self.places = np.frombuffer(data, "<u8", n_blocks, at)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at + 8 * n_blocks)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at + 8 * (n_blocks + n_docs)).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, dtype="<u4")
        first, last = a // self.block, (b - 1) // self.block
        words = np.frombuffer(self.data, "<u8", (last - first + 1) * self.width * self.block // 64, int(self.places[first]))
        return unpack_ids(words, self.width, self.block)[a - first * self.block:b - first * self.block].astype("<u4")

    def documents(self):
        """(doc_id, start in the file, ids) in order, unpacked some hundred blocks at a time."""
        step, lo, part, base = 256 * self.block, 0, np.zeros(0, "<u4"), 0
        for i, doc_id in enumerate(self.doc_ids.tolist()):
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            if b > base + len(part):
                part, base = self.ids(a, min(self.n_ids, max(b, a + step))), a
            yield doc_id, a, part[a - base:b - base]


def file_name(part: int, made: int) -> str:
    """Of the ``made``-th file of a partition. Its numbers order files, its text need not."""
    return f"ids-{part:09d}-{made:06d}.bin"


def first_ids(files: DataFrame, group: int = 1024) -> DataFrame:
    """``files`` (part, made, n_ids, ...) with ``first_id``: the ids of all files before, by the numbers of partition and file.

    Partitions are summed in groups of ``group`` consecutive ones; groups are summed up in order, and files only inside their group.
    """
    rows = files.withColumn("_g", F.expr(f"part div {group}"))
    sums = rows.groupBy("_g").agg(F.sum("n_ids").alias("_s"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.select("_g", F.coalesce(F.sum("_s").over(ahead.orderBy("_g")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n_ids").over(ahead.partitionBy("_g").orderBy("part", "made")), F.lit(0))
    return rows.withColumn("_in", inside).join(groups, "_g").withColumn("first_id", F.col("_base") + F.col("_in")).drop("_g", "_in", "_base")


def _write(folder: str, path: str, end_id: int, file_bytes_limit: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part, enc, made = TaskContext.get().partitionId(), encoder(path), 0
        store, base = fs.FileSystem.from_uri(folder)
        names, ids, room = [], [], 0

        def flush():
            nonlocal made, names, ids, room
            name = file_name(part, made)
            # The same task always writes the same bytes, so a second attempt may write over the first.
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(names, ids, id_bits(enc.size)))
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "made": [made], "n_docs": [len(names)], "n_ids": [sum(map(len, ids))]},
                                             schema=pa.schema([("name", pa.string()), *((c, pa.int64()) for c in ("part", "made", "n_docs", "n_ids"))]))
            made, names, ids, room = made + 1, [], [], 0
            return row

        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                names.append(doc_id)
                ids.append(np.concatenate([found, end]))
                room += len(found) + 1
                if room * 2 >= file_bytes_limit:
                    yield flush()
        if names:
            yield flush()
    return run


def write_packed(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end_id: int = END_ID, file_mb: int = 4) -> DataFrame:
    """Write the ids of all documents in ascending id order; returns the manifest (name, part, made, n_docs, n_ids, first_id).

    Files follow each other by the numbers ``part`` and ``made``; each holds documents of one range of ids. A null
    text is empty, so it has the end id alone. Rows with a null id come first, rows of one id go by their text. A range may begin inside
    an id, at a text with another beginning, so an id (or null) of many rows fills several.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.coalesce(nfc(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(nfc(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(partitions_for(spark, size), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    written = ordered.mapInArrow(_write(uri, vocabulary or default_vocabulary(), end_id, file_mb << 20), "name string, part long, made long, n_docs long, n_ids long")
    return first_ids(staged(written, "manifest"))


def _read(batches):
    for batch in batches:
        for content, path in zip(batch.column(0), batch.column(1).to_pylist()):
            part, made = (int(n) for n in path.rsplit("/", 1)[-1][:-len(".bin")].split("-")[1:])
            rows = [(None if d == NO_ID else d, part, made, a, len(ids), zlib.crc32(ids.tobytes())) for d, a, ids in PackedFile(content.as_buffer().to_pybytes()).documents()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "part", "made", "at", "n_tokens", "ids_crc32"])


def read_packed(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files in ``manifest``. Files are read where they are; their documents' numbers meet the manifest."""
    spark = manifest.sparkSession
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    found = files.select("content", "path").mapInArrow(_read, "doc_id long, part long, made long, at long, n_tokens long, ids_crc32 long")
    return (found.join(manifest.select("part", "made", "first_id"), ["part", "made"])
            .select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def packed_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all documents to packed files in the shared folder and read them back: one row per row of ``docs``.

    Null and empty texts hold the end id alone; null ids come first and stay null; repeated rows are written as often as they are there;
    an empty table writes no file and gives no row; other columns are ignored.
    """
    folder = shared_path(docs.sparkSession, "packed")
    manifest = staged(write_packed(docs, folder, id_col, text_col, vocabulary), "files")
    return read_packed(folder, manifest)
