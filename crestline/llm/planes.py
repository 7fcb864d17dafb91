"""Token ids on disk as compressed planes.

Ids are laid end to end in ascending document order and cut into blocks of a
fixed number of ids. A block is transposed into byte planes (all lowest bytes,
all second bytes, ...) or bit planes, and every plane is compressed by itself
with zstandard. The container is a Parquet folder, so that any file system
Spark writes to can hold it and a lost executor leaves no half-written file:

- ``blocks``: shard, block, n_ids, plane kind, planes, and the chunk index of
  the block (ids of the documents that begin in it and their offsets);
- ``shards``: shard, number of ids and documents, and the ids of all shards before it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crestline.llm.base import bound_batches, small, text_slices
from crestline.llm.tokens import default_path, encoder
from crestline.session import shared_dir

BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of a block of 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if kind == "bit":
        raw = np.concatenate([np.packbits((row >> b) & 1).reshape(1, -1) for row in raw for b in range(8)])
    z = zstandard.ZstdCompressor(level=level)
    return [z.compress(np.ascontiguousarray(row).tobytes()) for row in raw]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids that :func:`to_planes` packed."""
    z = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(z.decompress(p, max_output_size=n if kind == "byte" else (n + 7) // 8), np.uint8) for p in planes]
    if kind == "bit":
        bits = [np.unpackbits(r, count=n) for r in rows]
        rows = [sum(bits[8 * k + b].astype(np.uint8) << b for b in range(8)) for k in range(4)]
    return np.ascontiguousarray(np.stack(rows).T).view("<u4").reshape(-1)


def write_planes(
    docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 1, kind: str = "byte", block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, append ``end``, and write the two tables under ``path``.

    A null or empty text is ``end`` alone. Rows without an id come first; rows
    of equal ids are ordered by their text's hash. Every row becomes a document,
    repeated ones too; other columns are ignored. One shard is one sorted range
    of documents, written by one task that holds one block at a time.
    """
    bound_batches(docs)
    tokenizer = tokenizer or default_path()
    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = cols.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def fn(batches):
        shard, block, held, docs_in = TaskContext.get().partitionId(), 0, bytearray(), []
        enc = encoder(tokenizer)
        size = 4 * block_ids

        def row(data: bytes):
            ids = np.frombuffer(data, "<u4")
            out = [shard, block, len(ids), kind, to_planes(ids, kind), [d for d, _ in docs_in], [o for _, o in docs_in]]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(out, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, _, texts in text_slices(batch):
                for i, ids in enumerate(enc.encode(texts, end), a):
                    docs_in.append((names[i], len(held) // 4))
                    held += ids
                    while len(held) >= size:
                        yield row(bytes(held[:size]))
                        # A document that begins on the cut belongs to the next block.
                        del held[:size]
                        block, docs_in = block + 1, []
        if held:
            yield row(bytes(held))

    ordered.mapInArrow(fn, "shard int, block int, n_ids int, kind string, planes array<binary>, docs array<long>, offsets array<int>").write.parquet(f"{path}/blocks")
    spark = docs.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    per = blocks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n_ids"), F.sum(F.size("docs").cast("long")).alias("n_docs"))
    # One row per shard, so the running total is over as many rows as there were tasks.
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    per.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).write.parquet(f"{path}/shards")


_BLOCK = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))]
)


def read_planes(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the container.

    A shard's blocks are read in order by one task, as one task wrote them; a
    document that crosses blocks is carried on.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/shards")
    n = max(1, shards.count())
    ordered = blocks.repartitionByRange(n, "shard").sortWithinPartitions("shard", "block")

    def fn(batches):
        now, pos, open_doc = None, 0, None
        out: list[tuple] = []

        def close():
            nonlocal open_doc
            if open_doc is not None:
                name, start, count, crc, parts = open_doc
                out.append((now, name, start, count, crc, b"".join(parts)))
                open_doc = None

        def flush():
            cols = list(zip(*out))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

        def feed(data: bytes):
            name, start, count, crc, parts = open_doc
            if with_ids:
                parts.append(data)
            return name, start, count + len(data) // 4, zlib.crc32(data, crc), parts

        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: batch.column(j)[r].as_py() for j, k in enumerate(batch.schema.names)}
                if row["shard"] != now:
                    close()
                    now, pos = row["shard"], 0
                data = from_planes(row["planes"], row["n_ids"], row["kind"]).tobytes()
                cuts = [*row["offsets"], row["n_ids"]]
                if cuts[0] and open_doc is not None:
                    open_doc = feed(data[: 4 * cuts[0]])
                for name, a, b in zip(row["docs"], cuts, cuts[1:]):
                    close()
                    open_doc = (name, pos + a, 0, 0, [])
                    open_doc = feed(data[4 * a : 4 * b])
                pos += row["n_ids"]
                if len(out) >= 5_000:
                    yield flush()
        close()
        if out:
            yield flush()

    rows = ordered.mapInArrow(fn, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    rows = rows.join(small(shards.select("shard", "start")), "shard")
    cols = ["doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.select(*cols, *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` into a new container in the shared folder and read it back."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/planes-{uuid.uuid4().hex}"
    write_planes(docs, path, **options)
    return read_planes(docs.sparkSession, path)
