"""Counting 64-bit keys over the corpus in packed form.

A chunk of the corpus sends its different keys once each, sorted and cut into FAN buckets by their leading bits, each bucket as
one compressed binary value beside the counts. A bucket sums the counts of equal keys over all chunks and answers every chunk
in the order of the keys it sent. So a frequent key costs one entry for each chunk, however often it occurs.

Beyond GROUP chunks a bucket would hold too much, so it is cut again: the rows of GROUPED chunks in a bucket are merged into
one sorted list, which sends its keys as a chunk does, cut by the next bits, and hands the answers on to its members. Every
level sends FAN rows for each chunk at most, and there are as many levels as the logarithm of the number of chunks: messages
grow in proportion to the corpus, and no task holds more than GROUP rows of one bucket.

Masks of bits may be sent in place of counts; they are joined (MASKS). Keys that only filter may be cut to fewer leading bits (bits_for); keys that decide may come with 32 bits of a second hash
(checks), which have to be equal as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, partitions, stored

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SENT = "kind int, bucket long, chunk long, keys binary, counts binary, checks binary"
ANSWERED = "kind int, bucket long, chunk long, counts binary, keys_total long, counts_total long"
#: Kinds from this on send masks of 63 bits, which are joined instead of added.
MASKS = 64
#: Leading bits of a level, and buckets of it.
FAN_BITS, FAN = 7, 128
#: Chunks whose rows one bucket holds at most, and chunks merged into one where there are more.
GROUP, GROUPED = 512, 128

_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def squeeze(x: np.ndarray) -> bytes:
    """Numbers from 0 as compressed bytes, all first bytes before all second ones; bytes that are 0 in all are left out."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :width]
    return bytes([width]) + _COMPRESSOR.compress(planes.T.tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    width, size = data[0], np.dtype(dtype).itemsize
    planes = np.frombuffer(_DECOMPRESSOR.decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    if width == 1:
        return planes[0].astype(dtype)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, :width] = planes.T
    return out.view(dtype).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys, as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def bits_for(keys: int, spare: int = 8) -> int:
    """Leading bits of hashes that tell this many keys apart but for one in 2 ** spare: enough where equality only filters."""
    return min(64, max(16, int(np.ceil(np.log2(keys + 1)))) + spare)


def totals(kind: int, place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Sums by place; of kinds from MASKS on, all bits that are set."""
    if kind < MASKS:
        return np.bincount(place, weights=counts, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.bitwise_or.at(out, place, counts)
    return out


def sent(kind: int, chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int = 64, level: int = 0, bucket: int = 0, checks: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows for the sorted keys of a chunk (within a bucket of the level above), one for each bucket that has any."""
    borders = np.arange(1, FAN, dtype=np.uint64) + np.uint64(bucket * FAN)
    edges = np.array([0, *np.searchsorted(keys, borders << np.uint64(bits - FAN_BITS * (level + 1))), len(keys)])
    full = np.flatnonzero(np.diff(edges))
    cut = [slice(edges[b], edges[b + 1]) for b in full]
    counts = counts.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(full), kind, np.int32)), pa.array(full + bucket * FAN, pa.int64()), pa.array(np.full(len(full), chunk, np.int64)),
            pa.array([pack_keys(keys[s]) for s in cut], pa.binary()), pa.array([squeeze(counts[s]) for s in cut], pa.binary()), pa.array([None if checks is None else checks[s].astype(np.uint32).tobytes() for s in cut], pa.binary()),
        ],
        names=["kind", "bucket", "chunk", "keys", "counts", "checks"],
    )


def rows_of(batches: Iterator[pa.RecordBatch], held: int = 4_000_000) -> Iterator[tuple]:
    """Rows as tuples; about `held` bytes at a time become Python objects."""
    for batch in batches:
        step = max(1, min(256, held * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def grouped(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first `width` values."""
    key, found = None, []
    for row in rows:
        if found and row[:width] != key:
            yield key, found
            found = []
        key = row[:width]
        found.append(row)
    if found:
        yield key, found


def merged(keys: list[bytes], checks: list[bytes | None]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Of sorted lists: all different keys in order, their checks, the place of each given key among them, and the lists' ends."""
    lists = [unpack_keys(k) for k in keys]
    ends = np.cumsum([len(k) for k in lists])
    flat = np.concatenate(lists)
    every, place = np.unique(flat, return_inverse=True)
    if checks[0] is None:
        return every, None, place, ends
    own = np.frombuffer(b"".join(checks), np.uint32).astype(np.uint64)
    first = np.empty(len(every), np.uint64)
    first[place[::-1]] = own[::-1]
    if not (first[place] == own).all():  # different strings of one key
        both, place = np.unique(np.stack([flat, own], axis=1), axis=0, return_inverse=True)
        every, first, place = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), place.reshape(-1)
    return every, first, place, ends


def _answers(kind: int, buckets: list[int], chunks: list[int], sums: np.ndarray, ends: np.ndarray, known: int, total: int) -> pa.RecordBatch:
    n, starts = len(chunks), np.append(0, ends[:-1])
    keys_total, counts_total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    keys_total[0], counts_total[0] = known, total
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(buckets, pa.int64()), pa.array(chunks, pa.int64()), pa.array([squeeze(sums[a:z]) for a, z in zip(starts, ends, strict=True)], pa.binary()), pa.array(keys_total), pa.array(counts_total)],
        names=["kind", "bucket", "chunk", "counts", "keys_total", "counts_total"],
    )


def answered(emitted: DataFrame, chunks: int, bits: int = 64, level: int = 0) -> DataFrame:
    """For each row sent (by so many chunks), the sums over all chunks in the order of its keys. keys_total and counts_total,
    given once for each bucket, are its number of keys with a sum above 0, and the sum of all."""
    n = partitions(emitted.sparkSession)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), rows in grouped(rows_of(batches), 2):
            every, _, place, ends = merged([r[3] for r in rows], [r[5] for r in rows])
            total = totals(kind, place, np.concatenate([expand(r[4], np.int64) for r in rows]), len(every))
            yield _answers(kind, [bucket] * len(rows), [r[2] for r in rows], total[place], ends, np.count_nonzero(total), total.sum())

    if chunks <= GROUP or FAN_BITS * (level + 2) > bits:
        return emitted.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket", "chunk").mapInArrow(lean(direct), ANSWERED)
    groups = -(-chunks // GROUPED)
    held = stored(emitted.withColumn("lot", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("long")), "packed-held")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket, lot), rows in grouped(rows_of(batches), 3):
            every, checks, place, _ = merged([r[4] for r in rows], [r[6] for r in rows])
            counts = totals(kind, place, np.concatenate([expand(r[5], np.int64) for r in rows]), len(every))
            yield sent(kind, lot, every, counts, bits, level + 1, bucket, checks)

    key = ("kind", "bucket", "lot")
    members = held.select(*key, "chunk", "keys", "counts", "checks").repartition(n, *key).sortWithinPartitions(*key, "chunk")
    above = stored(answered(members.mapInArrow(lean(merge), SENT), groups, bits, level + 1), "packed-above")

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket, _), rows in grouped(rows_of(batches), 3):
            own, answers = [r for r in rows if not r[3]], [r for r in rows if r[3]]
            every, _, place, ends = merged([r[5] for r in own], [r[6] for r in own])
            sums = np.concatenate([expand(r[7], np.int64) for r in answers])
            if len(sums) != len(every):
                raise RuntimeError("answers and keys of a bucket differ in number")
            yield _answers(kind, [bucket] * len(own), [r[4] for r in own], sums[place], ends, sum(r[8] for r in answers), sum(r[9] for r in answers))

    null, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    down = held.select(*key, F.lit(0).alias("side"), "chunk", "keys", "checks", null.alias("sums"), zero.alias("known"), zero.alias("total")).unionByName(
        above.select("kind", F.shiftright("bucket", FAN_BITS).alias("bucket"), F.col("chunk").alias("lot"), F.lit(1).alias("side"), F.col("bucket").alias("chunk"), null.alias("keys"), null.alias("checks"), F.col("counts").alias("sums"), F.col("keys_total").alias("known"), F.col("counts_total").alias("total"))
    )
    return down.repartition(n, *key).sortWithinPartitions(*key, "side", "chunk").mapInArrow(lean(hand_on), ANSWERED)


def with_answers(chunks: DataFrame, answers: DataFrame, made: Callable[[tuple, dict[int, np.ndarray]], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """made(chunk row, sums by kind) for each row of chunks (chunk long, body binary) with its answers, in the order of the sent keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), rows in grouped(rows_of(batches), 1):
            body, sums = None, {}
            for _, kind, _, data in rows:
                if kind < 0:
                    body = data
                else:
                    sums.setdefault(kind, []).append(expand(data, np.int64))
            out = made((chunk, body), {k: np.concatenate(v) for k, v in sums.items()})
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    both = chunks.select("chunk", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.col("body").alias("data")).unionByName(answers.select("chunk", "kind", "bucket", F.col("counts").alias("data")))
    n = partitions(chunks.sparkSession)
    return both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(lean(run), schema)
