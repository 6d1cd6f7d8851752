"""Operator 2: token files of frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the corpus (most frequent first, ties by id), so that common tokens take one byte. A rank takes
one to four bytes, little-endian; the lengths stand apart in control bytes, two bits for each rank, four ranks a byte. Decoding
looks the control bytes up in a table of 256 rows and moves all bytes at once with numpy.

Layout of a token file set, written by Spark's own committer, so that lost executors leave nothing half-written:
``ranks`` (rank, id; as many rows as the vocabulary) and ``shards`` (shard, doc_id, start in the shard, n_tokens, control, data).
Shards follow each other in ascending ``doc_id``; rows lie in that order within a shard.

Null texts are empty documents (the end id alone); null ids come first; repeated ids are kept, ordered by their ids' bytes; an empty
table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, note_table, scratch_path, slices, temporary_tables, texts_of
from .library_ids import library_encoder

#: Lengths minus one of the four ranks of every control byte.
LENGTHS = np.array([[c >> 2 * k & 3 for k in range(4)] for c in range(256)], np.uint8)
_LANES = np.arange(4, dtype=np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    lanes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    lanes[: len(ranks)] = code
    control = lanes[0::4] | lanes[1::4] << 2 | lanes[2::4] << 4 | lanes[3::4] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[_LANES <= code[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    code = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[_LANES <= code[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """``doc_id, ids`` (bytes of little-endian integers as wide as the vocabulary needs)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() + end for x in encoder.encode(texts_of(part))], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def ranked_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``rank, id`` for the whole vocabulary by the counts of the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        total = np.zeros(encoder.size, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(ids, encoder.dtype), minlength=encoder.size) if len(ids) > encoder.size else 0
            small = b"".join(x for x in batch.column("ids").to_pylist() if len(x) <= encoder.size)
            total += np.bincount(np.frombuffer(small, encoder.dtype), minlength=encoder.size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode all texts and write the file set."""
    spark = docs.sparkSession
    with temporary_tables(spark):
        _write(materialise(encode_ids(docs, tokenizer, end_id), "ids", "zstd"), path, tokenizer)


def _write(encoded: DataFrame, path: str, tokenizer: str) -> None:
    spark = encoded.sparkSession
    # a row for each id of the vocabulary at most, whatever the corpus
    counts = ranked_ids(encoded, tokenizer).collect()
    encoder = library_encoder(tokenizer)
    total = np.zeros(encoder.size, np.int64)
    for row in counts:
        total[row.id] = row.n
    id_of_rank = np.argsort(-total, kind="stable")
    rank_of_id = np.empty(encoder.size, np.uint32)
    rank_of_id[id_of_rank] = np.arange(encoder.size, dtype=np.uint32)
    dtype = encoder.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, sizes, controls, datas = [], [], [], []
            for ids in batch.column("ids").to_pylist():
                ranks = rank_of_id[np.frombuffer(ids, dtype)]
                control, data = pack_ranks(ranks)
                starts.append(start)
                sizes.append(len(ranks))
                controls.append(control)
                datas.append(data)
                start += len(ranks)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * batch.num_rows, pa.int64()), batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(controls, pa.binary()), pa.array(datas, pa.binary())], names=["shard", "doc_id", "start", "n_tokens", "control", "data"])

    # the sampling of the range partitioner reads the written ids, so nothing is encoded twice
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(id_of_rank.tolist())], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    ordered.mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, control binary, data binary").write.parquet(f"{path}/shards", compression="zstd")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; ``start`` counts over all shards."""
    bounded_batches(spark)
    shards = spark.read.parquet(f"{path}/shards")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy()  # the vocabulary
    id_of_rank = ranks.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("control", "data", "n_tokens")]
            crcs = [zlib.crc32(id_of_rank[unpack_ranks(*x)].tobytes()) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    read = shards.mapInArrow(run, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long")
    # a row for each shard: as many as there were partitions
    sizes = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    base, bases = 0, []
    for row in sorted(sizes, key=lambda r: r.shard):
        bases.append((row.shard, base))
        base += row.n
    first = spark.createDataFrame(bases, "shard long, base long")
    return read.join(F.broadcast(first), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    note_table(spark, path)
    return read_token_files(spark, path)
