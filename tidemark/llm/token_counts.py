"""Token counts of documents in flat token files that have no index, by a separator scan.

A flat file is little-endian 16-bit ids with a separator id after each document and nothing else. Tasks scan
fixed blocks with one vectorised comparison each, whatever documents the block cuts; a prefix scan over the
blocks of a file then tells each block how many documents ended before it and where the last one ended.

Null or empty texts count 0 tokens. Rows are kept as they are, repeated ones too; a null id stays null.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, files
from tidemark.llm.encoder import encoder, vocabulary_path

SEPARATOR = 49408  # the first value that is no id of the vocabulary
BLOCK = 1 << 20  # ids


def write_flat(docs: DataFrame, folder: str, vocabulary: str, separator: int = SEPARATOR) -> DataFrame:
    """Write one flat file a partition; returns (file, ordinal, doc_id, file_ids), where file_ids is set on a file's last row."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/tokens-{TaskContext.get().partitionId():06d}.u16"
        out, ordinal, ids, e = None, 0, [], encoder(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                flat, at = e.encode(part.column(1).to_pylist())
                out = out or files.Output(name)
                out.write(np.insert(flat, at[1:], separator).astype("<u2").tobytes())
            if batch.num_rows:
                n = batch.num_rows
                ids.append(pa.table({"file": pa.array([name] * n), "ordinal": pa.array(range(ordinal, ordinal + n), pa.int64()), "doc_id": batch.column(0)}))
                ordinal += n
        if out:
            out.close()
            whole = pa.concat_tables(ids)
            total = pa.array([None] * (ordinal - 1) + [out.size // 2], pa.int64())
            yield from whole.append_column("file_ids", total).combine_chunks().to_batches()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "file string, ordinal long, doc_id long, file_ids long")


def count_tokens(token_files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, file_ids) of flat files -> (file, ordinal, n_tokens) of their documents."""
    blocks = token_files.select("file", "file_ids", F.explode(F.sequence(F.lit(0), ((F.col("file_ids") - 1) / block).cast("long"))).alias("block"))
    total = token_files.agg(F.sum("file_ids")).head()[0] or 0
    blocks = blocks.filter("file_ids > 0").repartition(common.tasks_for(token_files.sparkSession, 2 * total), "file", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(files.read_range(row["file"], row["block"] * block * 2, block * 2), "<u2")
                at = np.flatnonzero(ids == separator) + row["block"] * block
                yield pa.RecordBatch.from_pydict({"file": [row["file"]], "block": [row["block"]], "at": pa.array([at], pa.list_(pa.int64()))})

    found = blocks.mapInArrow(scan, "file string, block long, at array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "at",
        F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)).alias("ended"),
        F.coalesce(F.max(F.try_element_at("at", F.lit(-1))).over(before), F.lit(-1)).alias("last_end"),
    )
    lengths = F.expr("transform(at, (p, i) -> p - 1 - if(i = 0, last_end, at[i - 1]))")
    return stitched.select("file", "ended", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("ended") + F.col("i")).alias("ordinal"), "n_tokens")


def document_token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode documents into flat files in the shared folder, scan those, and name the counts: (doc_id, n_tokens, file, ordinal)."""
    spark: SparkSession = docs.sparkSession
    names = common.written(write_flat(docs, common.shared_dir(spark, "flat"), vocabulary or vocabulary_path()), "flat-names")
    counts = count_tokens(names.filter("file_ids is not null").select("file", "file_ids"))
    # File names compress so well that the table's size on disk says little of its size in memory: never broadcast it.
    return names.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
