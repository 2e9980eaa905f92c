"""Operator 13: token ids as length-delimited binary records with an offset index.

A record file is a chain of frames

    length of the payload, 8 bytes | its masked checksum, 4 bytes |
    payload | its masked checksum, 4 bytes

all little-endian; checksums are CRC-32C, rotated and shifted by a constant so
that a checksum of data that holds checksums stays useful. A payload is the width
of an id in bytes (2 or 4), the length of the key (-1 for a null key), the key in
UTF-8 and the ids. Beside each record file lies its index: for every record, and
once more for the end, the byte offset and the number of ids before it. A
manifest names the files of a finished write in their order; files that it does
not name, left by lost or repeated tasks, are never read.

Spark deals the documents to ranges of their ids, so that the files, in the order
of the manifest, hold the ids in ascending order; a range is about SHARD_BYTES of
text. The sink and the source are Python data sources: tasks write and read
through the file system that the path names, the driver writes the manifest.

Cases: a null or empty text is a record of its closing id alone; null ids come
first; rows of one id are ordered by a hash of their text and their place in the
table, so they may lie in several ranges; an empty table gives no files and no
rows; a very long text is one record (memory grows with the longest text); extra
columns are ignored. A damaged length, payload or index is an error.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from traitscan.llm.bpe import batches_of, merged, word_bpe
from traitscan.llm.common import small_batches
from traitscan.sources.formats import absolute, open_path

FORMAT = "token_records"
#: Bytes of text that one file holds, about; less if tasks would lie idle.
SHARD_BYTES = 32 << 20
#: Bytes that a reader takes from a file at once, if a record is not longer.
READ_BYTES = 8 << 20

# Fixed values of the record format: the CRC-32C polynomial (reflected) and the mask's constant.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_CHUNK = 64


def _zero_byte(v: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[v & 255] ^ (v >> np.uint32(8))


class Crc32c:
    """CRC-32C of many byte strings at once.

    The checksum is linear, so chunks of 64 bytes are looked up by place and
    byte, and chunks are combined by the linear maps for 64, 128, 256, ... zero
    bytes.
    """

    def __init__(self) -> None:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(CRC32C_POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
        self.table = t
        places = [t]
        for _ in range(_CHUNK - 1):
            places.append(_zero_byte(places[-1], t))
        self.places = np.concatenate(places[::-1])  # the first byte of a chunk is followed by 63 more
        self.offsets = np.arange(_CHUNK, dtype=np.uint16) * 256
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(_CHUNK):
            bits = _zero_byte(bits, t)
        self.maps = [self._tables(bits)]

    def _tables(self, bits: np.ndarray) -> np.ndarray:
        """Four tables of 256 for the map that takes bit i to bits[i]."""
        out = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for i in range(8):
                out[k] ^= np.where(np.arange(256) >> i & 1, bits[8 * k + i], np.uint32(0)).astype(np.uint32)
        return out

    @staticmethod
    def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        return m[0][v & 255] ^ m[1][v >> np.uint32(8) & np.uint32(255)] ^ m[2][v >> np.uint32(16) & np.uint32(255)] ^ m[3][v >> np.uint32(24)]

    def each(self, parts: list[bytes]) -> np.ndarray:
        """The checksum of each of `parts`, which have four bytes or more."""
        if not parts:
            return np.zeros(0, np.uint32)
        lengths = np.array([len(p) for p in parts], np.int64)
        if lengths.min() < 4:
            raise ValueError("a part of less than four bytes")
        chunks = -(-lengths // _CHUNK)
        last = np.cumsum(chunks)
        data = np.zeros(int(last[-1]) * _CHUNK, np.uint8)
        for p, n, end in zip(parts, lengths.tolist(), (last * _CHUNK).tolist(), strict=True):
            data[end - n : end] = np.frombuffer(p, np.uint8)  # zeros in front change nothing
            data[end - n : end - n + 4] ^= 255  # the register starts with ones
        rows = data.reshape(-1, _CHUNK)
        crc = np.empty(len(rows), np.uint32)
        for at in range(0, len(rows), 1 << 14):
            crc[at : at + (1 << 14)] = np.bitwise_xor.reduce(self.places[rows[at : at + (1 << 14)] + self.offsets], axis=1)
        left = np.repeat(last, chunks) - 1 - np.arange(len(rows))  # chunks that follow in the same part
        level = 0
        while (todo := left >> level).any():
            if level == len(self.maps):
                whole = self.maps[-1]
                bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
                self.maps.append(self._tables(self._apply(whole, self._apply(whole, bits))))
            odd = np.flatnonzero(todo & 1)
            crc[odd] = self._apply(self.maps[level], crc[odd])
            level += 1
        return ~np.bitwise_xor.reduceat(crc, last - chunks)


_CRC: list[Crc32c] = []


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """The masked checksum of each of `parts`."""
    if not _CRC:
        _CRC.append(Crc32c())
    crc = _CRC[0].each(parts)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def payload_of(key: str | None, ids: bytes) -> bytes:
    """The payload of a record; ids are little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    name = b"" if key is None else key.encode()
    return struct.pack("<Bi", width, -1 if key is None else len(name)) + name + (ids if width == 4 else wide.astype("<u2").tobytes())


def parse_payload(payload: bytes) -> tuple[str | None, bytes]:
    width, n = struct.unpack_from("<Bi", payload)
    at = 5 + max(n, 0)
    ids = payload[at:]
    return (None if n < 0 else payload[5:at].decode()), (ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def frames(payloads: list[bytes]) -> list[bytes]:
    """Payloads with their lengths and masked checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = zip(masked_crc32c(lengths).tolist(), masked_crc32c(payloads).tolist(), strict=True)
    return [b"".join([n, struct.pack("<I", a), p, struct.pack("<I", b)]) for n, p, (a, b) in zip(lengths, payloads, sums, strict=True)]


def unframe(data: bytes, starts: np.ndarray, name: str) -> list[bytes]:
    """The payloads of the frames at `starts` (with the end) in data, all checksums tested."""
    lengths, payloads, sums = [], [], []
    for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        frame = data[at:end]
        if len(frame) != end - at or len(frame) < 16 or struct.unpack_from("<Q", frame)[0] != len(frame) - 16:
            raise ValueError(f"{name}: a record's length and the index differ")
        lengths.append(frame[:8])
        payloads.append(frame[12:-4])
        sums.append((*struct.unpack_from("<I", frame, 8), *struct.unpack_from("<I", frame, len(frame) - 4)))
    want = np.array(sums, np.uint32).reshape(-1, 2)
    if (masked_crc32c(lengths) != want[:, 0]).any() or (masked_crc32c(payloads) != want[:, 1]).any():
        raise ValueError(f"{name}: a record does not have its checksum")
    return payloads


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    records: int
    ids: int


@dataclass
class Slices(InputPartition):
    """Ranges of records, (file, first, end, ids before the file), and the seed of their order, if any."""

    ranges: list[tuple[str, int, int, int]]
    seed: int | None = None


class TokenRecords(DataSource):
    """Format token_records: columns key string, ids binary; a read adds start and n_ids.

    Options: path; for reads also records_per_task (65,536) and shuffle_seed, with
    which blocks of records are dealt to random tasks and given in random order.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, start long, n_ids long, ids binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ARG002
        return RecordWriter(self.options["path"])

    def reader(self, schema: StructType) -> DataSourceReader:  # noqa: ARG002
        return RecordReader(dict(self.options))


class RecordWriter(DataSourceArrowWriter):
    """One file and one index a task; the manifest on the driver ends the write."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, place = open_path(self.path)
        files.create_dir(place, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        out = index = None
        offset = ids = records = 0
        try:
            for batch in iterator:
                keys, values = batch.column("key").to_pylist(), batch.column("ids").to_pylist()
                for lo in range(0, len(keys), 1024):
                    some = values[lo : lo + 1024]
                    if out is None:
                        out, index = files.open_output_stream(f"{place}/{name}.rec"), files.open_output_stream(f"{place}/{name}.idx")
                    entries = []
                    for frame, v in zip(frames([payload_of(k, v or b"") for k, v in zip(keys[lo : lo + 1024], some, strict=True)]), some, strict=True):
                        out.write(frame)
                        entries.append((offset, ids))
                        offset += len(frame)
                        ids += len(v or b"") // 4
                    records += len(some)
                    index.write(np.array(entries, "<u8").tobytes())
            if out is not None:
                index.write(np.array([offset, ids], "<u8").tobytes())
        finally:
            for f in (out, index):
                if f is not None:
                    f.close()
        return Written(part, name, records, ids)

    def commit(self, messages: list[Any]) -> None:
        files, place = open_path(self.path)
        files.create_dir(place, recursive=True)
        done, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.records), key=lambda m: m.part):
            done.append({"name": m.name, "records": m.records, "ids": m.ids, "before": before})
            before += m.ids
        with files.open_output_stream(f"{place}/manifest.json") as f:
            f.write(json.dumps({"files": done, "ids": before}).encode())

    def abort(self, messages: list[Any]) -> None:
        files, place = open_path(self.path)
        for m in messages:
            if m is not None and m.records:
                for end in ("rec", "idx"):
                    files.delete_file(f"{place}/{m.name}.{end}")


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("records_per_task", 1 << 16))
        self.seed = int(options["shuffle_seed"]) if "shuffle_seed" in options else None

    def partitions(self) -> list[Slices]:
        files, place = open_path(self.path)
        with files.open_input_stream(f"{place}/manifest.json") as f:
            found = json.loads(f.read())["files"]
        step = self.step if self.seed is None else max(1, self.step // 64)
        ranges = [(x["name"], lo, min(lo + step, x["records"]), x["before"]) for x in found for lo in range(0, x["records"], step)]
        if self.seed is None:
            return [Slices([r]) for r in ranges] or [Slices([])]
        order = np.random.default_rng(self.seed).permutation(len(ranges))
        tasks = max(1, -(-sum(x["records"] for x in found) // self.step))
        return [Slices([ranges[i] for i in order[t::tasks]], self.seed + t) for t in range(tasks)]

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        files, place = open_path(self.path)
        random = None if partition.seed is None else np.random.default_rng(partition.seed)
        for name, lo, hi, before in partition.ranges:
            with files.open_input_file(f"{place}/{name}.idx") as f:
                f.seek(16 * lo)
                raw = f.read(16 * (hi - lo + 1))
            if len(raw) != 16 * (hi - lo + 1):
                raise ValueError(f"{name}: the index is too short")
            index = np.frombuffer(raw, "<u8").reshape(-1, 2).astype(np.int64)
            runs = []
            at = 0
            while at < hi - lo:
                end = max(at + 1, int(np.searchsorted(index[:, 0], index[at, 0] + READ_BYTES, "right")) - 1)
                end = min(end, at + 1024, hi - lo)
                runs.append((at, end))
                at = end
            with files.open_input_file(f"{place}/{name}.rec") as f:
                for at, end in runs if random is None else [runs[i] for i in random.permutation(len(runs))]:
                    f.seek(int(index[at, 0]))
                    part = index[at : end + 1]
                    payloads = unframe(f.read(int(part[-1, 0] - part[0, 0])), part[:, 0] - part[0, 0], name)
                    rows = [(*parse_payload(p), start) for p, start in zip(payloads, (part[:-1, 1] + before).tolist(), strict=True)]
                    if random is not None:
                        rows = [rows[i] for i in random.permutation(len(rows))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[1]) // 4 for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                        names=["key", "start", "n_ids", "ids"],
                    )


def write_token_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text, close it with end_id and write it as records in ascending id order."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    order = ["id", F.xxhash64("text"), "_row"]
    parts = max(spark.sparkContext.defaultParallelism if size > 1 << 20 else 1, -(-size // shard_bytes))
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in merged(batches):
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, 1 << 21):
                ids = [x + end for x in bpe.encode(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], names=["key", "ids"])

    encoded = ranged.select(F.col("id").cast("string"), "text").mapInArrow(run, "key string, ids binary")
    spark.dataSource.register(TokenRecords)
    encoded.write.format(FORMAT).mode("append").option("path", absolute(path)).save()


def read_token_records(spark: SparkSession, path: str, shuffle_seed: int | None = None, records_per_task: int = 1 << 16) -> DataFrame:
    """(key, start, n_ids, ids) of all records; in file order, or shuffled by a seed."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format(FORMAT).option("path", absolute(path)).option("records_per_task", records_per_task)
    return (reader if shuffle_seed is None else reader.option("shuffle_seed", shuffle_seed)).load()
