"""Approximate nearest neighbours by multi-index hashing of learned binary codes (Norouzi, Punjani and Fleet, 2012).

A rotation is learned by iterative quantization (Gong and Lazebnik, 2011) on about SAMPLE vectors drawn by a hash, and a code is the signs
of the rotated, centred vector. Codes are cut into substrings of BITS bits, each with an index of its own. Two codes within
Hamming radius r agree within floor(r / substrings) bits in at least one substring, so probing the neighbourhood of each
substring of a query finds every code within r; these are then ranked by the exact distance of the floats. The radius is the
smallest with which the sample's own neighbours are found at the wanted rate (RECALL), measured by brute force on the sample.

Vectors are dealt into blocks, each indexed by one task in bounded memory; queries, a stated set, go to every block in
blocks of QUERY_BLOCK, and the nearest of the blocks are merged by query. Every vector is indexed, and nothing else is cut.

Vectors that are null, zero, empty, or hold a null or a value that is not finite take no part, as query or as candidate; so
do vectors of another length than the most frequent one, and null ids. Ids given twice: copies of the query's own id are not
its candidates; of another id, each row counts. With fewer candidates than k all found are returned; if the radius finds
fewer than k, it is raised for that query until it does. Ties in distance go to the
smaller id. An empty table gives an empty result. Other columns than vec_id and embedding are not read, so clashing names do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, stored

BITS, SAMPLE, ROUNDS, RECALL = 8, 8192, 30, 0.94
#: Vectors of an index block, and queries that go to it at once.
BLOCK, QUERY_BLOCK = 16_384, 4_096


@dataclass
class Codes:
    """The learned codes: centre, rotation, and the radius for the wanted recall."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as bytes, one substring each."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def padded_width(d: int) -> int:
    return max(BITS, -(-d // BITS) * BITS)


def learn(sample: np.ndarray, k: int, recall: float = RECALL, seed: int = 7) -> Codes:
    """Iterative quantization, and the radius from brute force over the sample."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    bits = padded_width(d)
    mean = sample.mean(axis=0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    base = vectors[:, ::-1]
    if bits > d:
        base = np.concatenate([base, rng.standard_normal((d, bits - d))], axis=1)
    v = x @ base
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(ROUNDS):
        b = np.where(v @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ b, full_matrices=False)
        turn = left @ right
    codes = Codes(mean, base @ turn, bits)
    own = codes.of(sample)
    queries = rng.choice(len(sample), min(256, len(sample)), replace=False)
    needed = []
    for q in queries:
        distance = ((sample - sample[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        near = np.argsort(distance)[: min(k, len(sample) - 1)]
        needed.append(np.bitwise_count(own[near] ^ own[q]).sum(axis=1))
    if needed and len(sample) > 1:
        codes.radius = int(np.quantile(np.concatenate(needed), recall, method="higher"))
    return codes


class Index:
    """One table for each substring: places of vectors by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            self.tables.append((order, np.searchsorted(codes[order, s], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius: every value of each substring within its share of it is probed."""
        share = radius // len(self.tables)
        found = np.zeros(len(self.codes), bool)
        for s, (order, edges) in enumerate(self.tables):
            for value in _FLIPS[min(share, BITS)] ^ code[s]:
                found[order[edges[value] : edges[value + 1]]] = True
        places = np.flatnonzero(found)
        return places[np.bitwise_count(self.codes[places] ^ code).sum(axis=1) <= radius]


_FLIPS = [np.array([sum(1 << b for b in c) for n in range(r + 1) for c in combinations(range(BITS), n)], np.int64) for r in range(BITS + 1)]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("embedding"))


def search(rows: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    vectors = stored(usable(rows), "ann-vectors")
    width = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    d, n = width["d"], width["count"]
    vectors = vectors.where(F.size("embedding") == d)
    hashed = F.pmod(F.xxhash64("vec_id", "embedding", F.lit("sample")), F.lit(1 << 30))
    drawn = vectors if n <= sample else vectors.where(hashed < int(sample / n * (1 << 30)))  # by a hash, about `sample` where the rows are
    fitted = sorted((r[0] for r in drawn.select("embedding").collect()))
    codes = spark.sparkContext.broadcast(learn(np.array(fitted), k, recall))
    queries = vectors.where(F.col("vec_id") % every == 0)
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))

    def pack(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(batch.schema.get_field_index("embedding")).flatten()).reshape(-1, d)
                ids, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for b in np.unique(part):
                    m = part == b
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([kind], pa.int32()), pa.array([ids[m].astype(np.int64).tobytes()], pa.binary()), pa.array([x[m].tobytes()], pa.binary())], names=["part", "kind", "ids", "data"])

        return run

    packed_schema = "part int, kind int, ids binary, data binary"
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("part")).mapInArrow(pack(1), packed_schema)
    asked = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), F.lit(query_blocks)).cast("int").alias("part")).mapInArrow(pack(0), packed_schema)
    # each block of queries meets each block of vectors once
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("block", F.col("part").alias("asked"), "kind", "ids", "data")
    right = dealt.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select(F.col("part").alias("block"), "asked", "kind", "ids", "data")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.llm.packed import grouped, rows_of

        c = codes.value
        for _, group in grouped(rows_of(batches), 2):
            parts = {0: [], 1: []}
            for _, _, kind, ids, data in group:
                parts[kind].append((np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, d)))
            if not parts[0] or not parts[1]:
                continue
            query_ids, q, ids, x = (np.concatenate([p[i] for p in parts[kind]]) for kind in (0, 1) for i in (0, 1))
            index, codes_q = Index(c.of(x)), c.of(q)
            out = []
            for i, (own, code) in enumerate(zip(query_ids, codes_q, strict=True)):
                radius = c.radius
                while True:
                    places = index.within(code, radius)
                    places = places[ids[places] != own]
                    if len(places) >= k or radius >= codes_q.shape[1] * BITS:
                        break
                    radius = min(codes_q.shape[1] * BITS, radius + 2)
                score = np.sqrt(((x[places] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[places], score))[:k]
                out.append((np.full(len(best), own), ids[places][best], score[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["query_id", "vec_id", "score"])

    both = left.unionByName(right).repartition(max(partitions(spark), blocks), "block", "asked").sortWithinPartitions("block", "asked", "kind")
    near = both.mapInArrow(found, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
