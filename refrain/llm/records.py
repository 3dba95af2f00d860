"""Length-delimited binary records of token ids, with a separate offset index.

A dataset is a folder of shard files and an index table. Each record of a shard is

    uint64  length of the payload in bytes
    uint32  masked CRC-32 of those eight bytes
    bytes   payload: the ids as little-endian uint16 (vocabularies under 65,536 ids) or uint32
    uint32  masked CRC-32 of the payload

all little-endian; the mask is ``rotate_right(crc, 15) + 0xa282ead8`` modulo 2**32, so
that a checksum stored next to checksummed data does not check itself. The index has a
row per record (shard, byte offset, length, tokens before it in the shard), which lets a
reader fetch any record, in any order, with one seek.

Defined results: a null text is an empty one (its record holds the end id alone); equal
doc_ids keep one record each, ordered by text; a null doc_id comes first; an empty input
gives an empty index and no shard; an id outside the stated vocabulary is an error. Texts are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .tokenization import ENCODE_BYTES, encoder, joined_ids, slices

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
INDEX_SCHEMA = "shard int, record long, doc_id long, offset long, length long, n_tokens long, shard_start long"
SLICE = 512


class CorruptRecord(ValueError):
    """A frame whose length or payload doesn't match its checksum."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises :class:`CorruptRecord` when a checksum or the length is wrong."""
    if len(data) < HEAD.size + 4:
        raise CorruptRecord("the frame is cut off")
    length, check = HEAD.unpack_from(data)
    if check != masked_crc(data[:8]):
        raise CorruptRecord("the length doesn't match its checksum")
    if len(data) != HEAD.size + length + 4:
        raise CorruptRecord(f"{length} payload bytes were announced, the frame has {len(data) - HEAD.size - 4}")
    payload = data[HEAD.size : HEAD.size + length]
    if struct.unpack_from("<I", data, HEAD.size + length)[0] != masked_crc(payload):
        raise CorruptRecord("the payload doesn't match its checksum")
    return payload


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def write_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 49_408) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the index (also stored under ``out_dir/index``).

    One range shuffle puts the documents in order; every task then writes one shard under a
    name of its own attempt and renames it, so a repeated task replaces its shard with equal bytes.
    """
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        files, folder = _filesystem(out_dir)
        files.create_dir(folder, recursive=True)
        final = f"{folder}/shard-{shard:06d}.rec"
        draft = f"{folder}/.shard-{shard:06d}.{attempt}"
        coder, sink, offset, record, before = encoder(tokenizer), None, 0, 0, 0
        for batch in slices(batches, 1, ENCODE_BYTES):
            if sink is None:
                sink = files.open_output_stream(draft)
            ids, bounds = joined_ids(*coder.encode(batch.column(1)), end_id)
            if len(ids) and int(ids.max()) >= vocabulary:
                raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {vocabulary}")
            small = ids.astype(width)
            starts, lengths = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                data = frame(small[a:b].tobytes())
                sink.write(data)
                starts.append(offset)
                lengths.append(len(data))
                offset += len(data)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(record, record + n, dtype=np.int64)),
                    batch.column(0),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array((bounds[:-1] + before).astype(np.int64)),
                ],
                names=[f.split()[0] for f in INDEX_SCHEMA.split(", ")],
            )
            record += n
            before += int(bounds[-1])
        if sink is not None:
            sink.close()
            files.move(draft, final)

    ordered = columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")).repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, INDEX_SCHEMA).write.mode("overwrite").parquet(f"{out_dir}/index")
    return read_index(docs.sparkSession, out_dir)


def read_index(spark, out_dir: str) -> DataFrame:
    """The index with ``start``: the ids of all records before, over all shards."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")
    # One row a shard comes to the driver; shards are as many as shuffle partitions.
    sums = sorted((r.shard, r.n) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases, total = [], 0
    for shard, n in sums:
        bases.append((shard, total))
        total += n
    base = spark.createDataFrame(bases, "shard int, base long")
    return index.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_records(index: DataFrame, out_dir: str, vocabulary: int = 49_408, checks_only: bool = False) -> DataFrame:
    """Read the records that ``index`` rows name, checksums verified: doc_id, start, n_tokens, ids (or only ids_crc32).

    The index may be filtered or shuffled first. Neighbouring records are read with one request.
    A record whose payload hasn't the number of ids that the index says raises :class:`CorruptRecord`.
    """
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    last = "ids_crc32 long" if checks_only else "ids_crc32 long, ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(out_dir)
        opened, name = None, None
        for big in batches:
            for low in range(0, big.num_rows, SLICE):
                batch = big.slice(low, SLICE)
                shards, at, size, said = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
                checks, lists, held, held_at = [], [], b"", -1
                for i, (shard, offset, length) in enumerate(zip(shards, at, size, strict=True)):
                    if shard != name:
                        opened, name, held = files.open_input_file(f"{folder}/shard-{shard:06d}.rec"), shard, b""
                    if not held_at <= offset <= offset + length <= held_at + len(held):
                        end, j = offset + length, i + 1
                        while j < len(at) and shards[j] == shard and at[j] == end and end - offset < 4 << 20:
                            end, j = end + size[j], j + 1
                        held, held_at = opened.read_at(end - offset, offset), offset
                    ids = np.frombuffer(unframe(held[offset - held_at : offset - held_at + length]), width).astype("<u4")
                    if len(ids) != said[i]:
                        raise CorruptRecord(f"the index says {said[i]} ids, the payload has {len(ids)}")
                    checks.append(zlib.crc32(ids.tobytes()))
                    if not checks_only:
                        lists.append(ids.astype(np.int32))
                out = [batch.column(3), batch.column(4), batch.column(5), pa.array(checks, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if not checks_only:
                    out, names = [*out, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return index.select("shard", "offset", "length", "doc_id", "start", "n_tokens").mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")
