"""Token-id files with bit-plane shuffling.

Documents are dealt by ranges of doc_id into shards, encoded, and cut into chunks of whole documents. A chunk's ids
are cut into fixed-size blocks; each block is transposed into bit or byte planes; the blocks' parts of one plane stand
together and are compressed with zstandard. A chunk is one self-describing byte string (`pack_ids`) in a Parquet row
beside its documents; Spark's committed writer makes the files, so a task run twice leaves one copy. The chunk index, a
table of its own beside the chunks, has what a reader needs to seek: shard, chunk, the store's ids before the shard and
before the chunk, ids, first and last doc_id, bytes.

Defined cases: null text is an empty text, whose ids are the end id alone; null doc_ids sort first; rows that share a
doc_id keep their own ids and stand by a hash of their text, then as they were read, so that even one doc_id of a third of
all rows is dealt to many shards; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithlink.llm.bpe import byte_bpe, crc
from kithlink.llm.common import text_of

MAGIC, BLOCK, CHUNK_IDS = b"KLP1", 4096, 1 << 18
CHUNKS = "shard int, chunk int, ids_before long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, payload binary"
INDEX = "shard int, chunk int, base long, ids_before long, n_ids long, first_doc_id long, last_doc_id long, n_bytes int"


def _planes(ids: np.ndarray, width: int, mode: str, block: int) -> np.ndarray:
    """Planes as rows of bytes; in each, block after block."""
    n = -(-len(ids) // block) * block
    padded = np.zeros(n, dtype=f"<u{width}")
    padded[: len(ids)] = ids
    raw = padded.view(np.uint8).reshape(-1, block, width)
    if mode == "byte":
        return np.ascontiguousarray(raw.transpose(2, 0, 1)).reshape(width, -1)
    bits = np.unpackbits(raw, axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2).reshape(8 * width, -1)


def pack_ids(ids: np.ndarray, mode: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    """Header (magic, ids, block, width, mode, planes, plane sizes), then the compressed planes. block: a multiple of 8."""
    import zstandard

    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    z = zstandard.ZstdCompressor(level=level)
    parts = [z.compress(p.tobytes()) for p in _planes(ids, width, mode, block)]
    head = struct.pack("<4sQIBBH", MAGIC, len(ids), block, width, mode == "bit", len(parts))
    return head + struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unpack_ids(data: bytes) -> np.ndarray:
    import zstandard

    magic, n, block, width, bit, k = struct.unpack_from("<4sQIBBH", data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = struct.calcsize("<4sQIBBH")
    sizes, at = struct.unpack_from(f"<{k}I", data, at), at + 4 * k
    z, planes = zstandard.ZstdDecompressor(), []
    for s in sizes:
        planes.append(np.frombuffer(z.decompress(data[at : at + s]), dtype=np.uint8))
        at += s
    if bit:
        bits = np.unpackbits(np.stack(planes).reshape(k, -1, block // 8), axis=2)
        raw = np.packbits(np.ascontiguousarray(bits.transpose(1, 2, 0)), axis=2, bitorder="little")
    else:
        raw = np.ascontiguousarray(np.stack(planes).reshape(k, -1, block).transpose(1, 2, 0))
    return raw.reshape(-1).view(f"<u{width}")[:n].astype("<u4")


def write_store(docs: DataFrame, path: str, *, end_id: int = 0, mode: str = "byte", folder: str | None = None) -> None:
    """Encode docs (doc_id, text) and write them to path in ascending doc_id order."""

    def encode(batches):
        bpe, shard, chunk, before = byte_bpe(folder), TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, held = [], [], 0

        def flush():
            nonlocal chunk, before, ids, doc_ids, held
            all_ids = np.concatenate(ids)
            lens = [len(x) for x in ids]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([before], pa.int64()), pa.array([len(all_ids)], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([pack_ids(all_ids, mode)], pa.binary()),
                ],
                names=["shard", "chunk", "ids_before", "n_ids", "doc_ids", "doc_lens", "payload"],
            )
            chunk, before = chunk + 1, before + len(all_ids)
            ids, doc_ids, held = [], [], 0
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = bpe.encode_array(text.as_py(), end_id)
                ids.append(x)
                doc_ids.append(doc_id)
                held += len(x)
                if held >= CHUNK_IDS:
                    yield flush()
        if ids:
            yield flush()

    order = ["doc_id", "h", "at"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, CHUNKS).write.parquet(f"{path}/chunks")
    spark = docs.sparkSession
    c = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    shards = c.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))  # a row per shard
    index = c.join(F.broadcast(base), "shard")  # no more rows than the write had tasks
    index.select(
        "shard", "chunk", "base", "ids_before", "n_ids", F.get("doc_ids", F.lit(0)).alias("first_doc_id"),
        F.get("doc_ids", F.size("doc_ids") - 1).alias("last_doc_id"), F.length("payload").alias("n_bytes"),
    ).write.parquet(f"{path}/index")


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index: where each chunk lies, with the ids of all documents before it in the whole store."""
    return spark.read.schema(INDEX).parquet(f"{path}/index").withColumn("start", F.col("base") + F.col("ids_before"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. Chunks are read each on its own."""

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_ids(r["payload"])
                ends = np.cumsum(r["doc_lens"], dtype=np.int64)
                starts = ends - np.asarray(r["doc_lens"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"], pa.int64()), pa.array(r["doc_lens"], pa.int64()),
                        pa.array([crc(ids[s:e]) for s, e in zip(starts, ends)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    c = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "ids_before", "doc_ids", "doc_lens", "payload")
    base = F.broadcast(chunk_index(spark, path).where("chunk = 0").select("shard", "base"))  # no more rows than the write had tasks
    rows = c.join(base, "shard").select((F.col("base") + F.col("ids_before")).alias("start"), "doc_ids", "doc_lens", "payload")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
