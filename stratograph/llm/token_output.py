"""Token ids as Parquet list columns, written in order of id and read selectively.

Each row has a document's ids as list<int> beside small metadata columns.  Version-2 pages
let the writer dictionary-encode ids and delta-encode the integer columns; row groups and
pages are kept small and carry page indexes, so a reader of metadata, or of a few documents,
touches only their pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Encoder
from .common import by_arrow, col, partitions, scratch

#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.column.index.truncate.length": "32",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, part, n_tokens, ids) files in ascending doc_id order.

    Null text counts as empty: such documents hold the end id alone.  Null ids come first.
    Rows are range-partitioned by id and sorted within a partition; part numbers the
    partitions in that order.  An empty table writes no rows.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    spread = F.xxhash64("text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", spread).sortWithinPartitions("doc_id", spread)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches):
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        for batch in batches:
            for piece in encoder.pieces(batch.column(1)):
                values, offsets = encoder.encode(batch.column(1).slice(*piece), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(*piece),
                        pa.array(np.full(piece[1], part, np.int32)),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)),
                    ],
                    schema=schema,
                )

    out = by_arrow(rows, encode, "doc_id long, part int, n_tokens long, ids array<int>")
    out.write.options(**WRITER).parquet(path)


def token_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of a token dataset, from its metadata columns alone."""
    rows = spark.read.parquet(path).select("doc_id", "part", "n_tokens", F.monotonically_increasing_id().alias("at"))
    return _starts(rows).select("doc_id", "start", "n_tokens")


def _starts(rows: DataFrame) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("inside"))


def read_digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all taken from the files."""

    def digest(batches):
        for batch in batches:
            ids = batch.column(2)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "n_tokens", "ids_crc32"],
            )

    rows = spark.read.parquet(path).select("doc_id", "part", "ids")
    rows = by_arrow(rows, digest, "doc_id long, part int, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    return _starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, path: str | None = None, **columns) -> DataFrame:
    """Write the token files (to a new shared path unless given) and digest them from disk."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, **columns)
    return read_digest(spark, path)
