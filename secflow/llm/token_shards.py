"""Training-order materialisation: token sequences in permuted order, in fixed-stride shards.

Every text becomes its token ids and an end token, cut into sequences of ``length`` tokens,
the last one padded. Sequences are numbered 0 .. N-1 by (hash of the id, id, part): a
count per hash range first, then numbers within each range, so no task holds more than one
range. A keyed Feistel network over the smallest even number of bits that holds N permutes
the numbers; numbers that fall outside 0 .. N-1 are permuted again (cycle walking), so
every sequence gets a slot of its own and every slot is filled. Range partitions of the
slots write shards of ``per_shard`` records, each record of the same number of bytes: slot
s lies in shard s // per_shard at byte (s % per_shard) * stride of its ``records``. Shards
are the rows of a Parquet table in slot order, one folder a range of them, so that their
padding is compressed; ``read_from`` continues at any slot, and opens neither the folders
nor the row groups that lie before it.

Record, little-endian: doc_id int64, part uint32, real tokens uint32, then ``length`` ids
as uint16 (uint32 for larger vocabularies). On their way to the shard records are without
padding.

Rows: null and empty texts are one sequence that holds the end token; a null id is written
as -2**63; repeated rows are sequences of their own, ordered by their bytes; texts are
encoded whole, whatever their length; columns other than the id and the text are left out;
an empty table makes no shards. The order depends on ids, texts and key only, not on the
files' layout.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from secflow.llm.bpe import codec, default_vocabulary
from secflow.llm.common import discard, materialise, new_table, read, shuffles_dropped

LENGTH, PER_SHARD, KEY = 1024, 256, 0x5EC0F10A
NO_ID = -(1 << 63)
HEADER = np.dtype([("doc_id", "<i8"), ("part", "<u4"), ("n", "<u4")])
ROUNDS = 6
#: Shards that one task writes at least, and tasks at most before it writes more.
SHARDS_PER_TASK, TASKS = 24, 100_000


def _round(half: np.ndarray, key: int, i: int) -> np.ndarray:
    h = half + np.uint64((key + i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers below n: a bijection of 0 .. n-1."""
    bits = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> width, out[todo] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, i) & mask)
        out[todo] = left << width | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def stride(length: int, vocabulary_size: int) -> int:
    return HEADER.itemsize + length * (2 if vocabulary_size <= 1 << 16 else 4)


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, part, record) of every sequence of every document; records without padding."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        end = next(iter(bpe.special.values()), bpe._size)
        kind = np.dtype("<u2" if bpe._size + 1 <= 1 << 16 else "<u4")
        last, size, head = np.array([end], kind).tobytes(), length * kind.itemsize, struct.Struct("<qII").pack  # as HEADER
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, parts, records = [], [], []
                for doc_id, t in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist(), strict=True):
                    tokens = bpe.encode(t or "")
                    body, n, own = tokens.astype(kind).tobytes() + last, len(tokens) + 1, NO_ID if doc_id is None else doc_id
                    count = -(-n // length)
                    ids += [doc_id] * count
                    parts += range(count)
                    records += [head(own, k, min(length, n - k * length)) + body[k * size : (k + 1) * size] for k in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(records, pa.binary())], ["doc_id", "part", "record"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(cut, "doc_id long, part int, record binary")


def materialise_order(docs: DataFrame, vocabulary: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, text: str = "text", shards_per_task: int = SHARDS_PER_TASK) -> DataFrame:
    """The shards (shard, first_slot, n, stride, records, task), written to the shared folder in slot order, a folder a task."""
    spark = docs.sparkSession
    # Ranges of hashes are dealt before anything is encoded, so that sequences go from their
    # encoder to their range and are written once, with their place in it.
    ranges = max(1, math.isqrt(docs.count()))
    spread = sequences(docs, vocabulary, length, text).withColumn("h", F.xxhash64(F.lit(key), "doc_id"))
    spread = spread.withColumn("range", F.floor((F.shiftrightunsigned("h", 32)) * ranges / F.lit(1 << 32)))
    inside = Window.partitionBy("range").orderBy("h", "doc_id", "part", "record")
    with shuffles_dropped(spark):
        made = materialise(spread.withColumn("place", F.row_number().over(inside)).select("range", "place", "record"), "sequences", "zstd")
    total = made.count()
    starts = made.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.withColumn("start", F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).drop("rows")
    numbered = made.join(F.broadcast(starts), "range").select((F.col("start") + F.col("place") - 1).alias("number"), "record")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permute(batch.column(0).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(1)], ["slot", "record"])

    shards = -(-total // per_shard)
    each = max(shards_per_task, -(-shards // TASKS))
    task = F.floor(F.col("slot") / (per_shard * each)).cast("int")
    # Ranges of slots are known beforehand: no sampling, and no task starts inside a shard.
    placed = numbered.mapInArrow(place, "slot long, record binary")
    ordered = placed.repartitionById(max(1, -(-shards // each)), task).sortWithinPartitions("slot")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One shard at a time is held: its records arrive in slot order.
        shard, held = None, []

        def close() -> pa.RecordBatch:
            size = stride(length, codec(vocabulary)._size + 1)
            end = next(iter(codec(vocabulary).special.values()), codec(vocabulary)._size)
            pad = np.full(length, end, "<u2" if size == HEADER.itemsize + 2 * length else "<u4").tobytes()
            blob = b"".join(r + pad[len(r) - HEADER.itemsize :] for r in held)
            row = [shard, shard * per_shard, len(held), size, blob, shard // each]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()), strict=True)], ["shard", "first_slot", "n", "stride", "records", "task"])

        for batch in batches:
            for s, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s // per_shard != shard and held:
                    yield close()
                    held = []
                shard = s // per_shard
                held.append(r)
        if held:
            yield close()

    path, made_shards = new_table(spark, "shards"), ordered.mapInArrow(join, "shard long, first_slot long, n int, stride int, records binary, task int")
    with shuffles_dropped(spark):
        made_shards.write.partitionBy("task").parquet(path, compression="zstd")
    discard(spark, made)
    return spark.read.schema(made_shards.schema).parquet(path)


def read_from(shards: DataFrame, slot: int = 0, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """The records from a slot on: slot, shard, byte offset, doc_id, part, n_tokens, crc32 of the real tokens' bytes, and token_ids if asked for."""

    names = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "tokens_crc32", "token_ids"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, size, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                skip = max(0, slot - first)
                width = (size - HEADER.itemsize) // length
                rows = np.frombuffer(blob, np.dtype([("head", HEADER), ("ids", f"<u{width}", length)]))[skip:]
                heads = rows["head"]
                bodies = [r[:k] for r, k in zip(rows["ids"], heads["n"], strict=True)]
                columns = [
                    pa.array(np.arange(first + skip, first + n)), pa.array(np.full(n - skip, shard)), pa.array(np.arange(skip, n) * size),
                    pa.array(heads["doc_id"], mask=heads["doc_id"] == NO_ID), pa.array(heads["part"].astype(np.int32)), pa.array(heads["n"].astype(np.int32)),
                    pa.array([zlib.crc32(b.tobytes()) for b in bodies], pa.int64()),
                ]
                if with_ids:
                    ids = [b.astype(np.int32) for b in bodies]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    kept = shards
    if slot > 0:
        # The slot's shard starts a folder or lies in one; what comes before is neither listed for reading nor opened.
        begin = shards.where(F.col("first_slot") <= slot).agg(F.max_by(F.struct("task", "first_slot"), "first_slot").alias("b")).first()["b"]
        if begin is not None:
            kept = shards.where((F.col("task") >= begin["task"]) & (F.col("first_slot") >= begin["first_slot"]))
    kept = kept.select("shard", "first_slot", "n", "stride", "records").where(F.col("first_slot") + F.col("n") > slot)
    return kept.mapInArrow(split, "slot long, shard long, byte_offset long, doc_id long, part int, n_tokens int, tokens_crc32 long" + (", token_ids array<int>" if with_ids else ""))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return read_from(materialise_order(docs, default_vocabulary()), with_ids=False)


QUERIES = {"op8_token_shards": op8_token_shards}
ORACLES: dict[str, str] = {}
