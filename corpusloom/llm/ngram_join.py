"""N-gram Jaccard join by T-occurrence search (DivideSkip: Li, Lu and Lu, 2008).

1. Every document becomes its set of five-word shingles, as 64-bit hashes. The number of documents that hold a shingle is
   counted over the whole corpus in packed form (packed.py), and each chunk gets back the numbers of its own shingles.
2. A link needs an overlap of at least 0.8 of either set, so a document of which less than 0.8 is held by any other document
   has no link. That leaves copies and near copies. Equal sets become one node.
3. Two linked nodes share one of the first n - ceil(0.8 n) + 1 shingles in the order of rising frequency (less those that
   only one document holds). Nodes that share such a shingle, directly or in steps, form a cluster; only the nodes of a
   cluster can link. No pairs are made for that: each shingle ties its nodes to the least one.
4. In a cluster, each node is searched in the inverted lists of the others: the short lists are merged, nodes that reach the
   threshold less the number of long lists are looked up in the long lists by binary search, and those with the required
   overlap are linked. A cluster whose sets exceed BLOCK_BYTES is dealt with as pairs of blocks, each pair a task of its own,
   so no task holds more than two blocks.
5. All links are found and counted, but a task hands out sums: for each node its number of links, and of the links those that
   join two groups not joined before in the task, as no others change the components. These give the least doc_id that can be
   reached. The pairs themselves, whose number is the square of a cluster's, are a table of their own for those who want them.

Document frequencies only filter and order, so shingles are counted by as many leading bits of their hash as tell them apart
but for one in 256; overlaps are those of whole 64-bit hashes, and two different shingles are taken for equal with a
probability of n^2 / 2^65 for the n shingles of a cluster.

Nulls, empty texts and texts without words: an empty set, linked with nothing. Repeated rows are equal sets, so one node, and
linked. Ties in frequency are ordered by hash. Very long texts count whole. Rows of equal doc_id and different text keep their
own sets. An empty table gives an empty result. Other columns than doc_id and text are not read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import packed
from corpusloom.llm.common import dropped, lean, partitions, released, stored
from corpusloom.llm.components import components
from corpusloom.llm.packed import M1, mixed
from corpusloom.llm.words import chunked, extent, opened

WIDTH, PERCENT = 5, 80
#: Bytes of shingle sets of one block of a large cluster.
BLOCK_BYTES = 1_000_000
#: Links that leave a task at once.
LINKS_HELD = 16_384
#: Weight of a list's logarithm when long lists are told from short ones.
MU = 0.01


def least_overlap(n: int | np.ndarray, percent: int):
    """Shingles that a set of n shares with any set it links with."""
    return (percent * n + 99) // 100


def shingles(body: bytes, width: int = WIDTH):
    """Of a chunk: ids, number of different shingles of each document, and document number and key of each of these, by document and key."""
    ids, _, lengths, words, hashes = opened(body)
    h = hashes[words] if len(words) else np.empty(0, np.uint64)
    n, ends = len(h), np.cumsum(lengths)
    starts = ends - lengths
    acc = h.copy()
    full = np.zeros(n, bool)
    for k in range(1, width):
        acc[: max(0, n - k)] = mixed(acc[: max(0, n - k)] * M1 + h[k:])
    doc = np.repeat(np.arange(len(ids)), lengths)
    full = np.arange(n) + width <= ends[doc] if n else full
    docs, keys = doc[full], acc[full]
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        own = []
        for d in short:
            x = np.uint64(lengths[d])
            for y in h[starts[d] : ends[d]]:
                x = mixed(np.array([x]) * M1 + y)[0]
            own.append(x)
        docs, keys = np.concatenate([docs, short]), np.concatenate([keys, np.array(own, np.uint64)])
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    if len(keys):
        new = np.append(True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1]))
        docs, keys = docs[new], keys[new]
    return ids, np.bincount(docs, minlength=len(ids)), docs, keys


def sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Stored rows of doc_id, n_shingles, and for documents that may have a link: node (16 bytes, by the set alone) and their shingles that
    other documents hold too, the rarest first."""
    chunks = chunked(docs, F.lit(False), "join-chunks")
    n_chunks, n_words = extent(chunks)
    bits = packed.bits_for(n_words)
    cut = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, body in packed.rows_of(batches):
            keys, counts = np.unique(shingles(body, width)[3] >> cut, return_counts=True)
            yield packed.sent(0, chunk, keys, counts, bits)

    answers = stored(packed.answered(chunks.select("chunk", "body").mapInArrow(lean(send), packed.SENT), n_chunks, bits), "join-answers")
    released(docs.sparkSession)
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()

    def made(row: tuple, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        ids, sizes, _, keys = shingles(row[1], width)
        if len(keys):
            held = sums[0][np.unique(keys >> cut, return_inverse=True)[1]]
        ends = np.cumsum(sizes)
        nodes, own = [], []
        for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            k = keys[end - n : end]
            f = held[end - n : end] if n else k
            common = f >= 2
            if n and 100 * int(common.sum()) >= percent * n:
                nodes.append(xxhash.xxh3_128_digest(k.tobytes()))
                own.append(k[common][np.argsort(f[common], kind="stable")].tobytes())
            else:
                nodes.append(None)
                own.append(None)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes.astype(np.int64)), pa.array(nodes, pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "n_shingles", "node", "keys"])

    out = stored(packed.with_answers(chunks, answers, made, f"doc_id {kind}, n_shingles long, node binary, keys binary"), "join-sets")
    dropped(chunks, answers)
    released(docs.sparkSession)
    return out


def search(sizes: np.ndarray, keys: list[np.ndarray], block: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links of a group, as arrays of x, of y, and of whether the link joins two parts not joined before; where it has two
    blocks, links between the blocks only."""
    order = np.argsort(sizes, kind="stable")
    n = len(order)
    size, blocks = sizes[order].astype(np.int64), block[order]
    across = len(np.unique(blocks)) > 1
    lengths = np.array([len(keys[i]) for i in order])
    _, token = np.unique(np.concatenate([keys[i] for i in order]), return_inverse=True)
    token_ends = np.cumsum(lengths)
    node = np.repeat(np.arange(n), lengths)
    lists = node[np.argsort(token, kind="stable")]  # nodes of each shingle, rising
    list_ends = np.cumsum(np.bincount(token))
    list_starts = np.append(0, list_ends[:-1])
    label = np.arange(n)
    links, held = [], 0
    for x in range(n):
        need = int(least_overlap(size[x], percent))
        own = token[token_ends[x] - lengths[x] : token_ends[x]]
        lo = int(np.searchsorted(size, need))  # smaller sets cannot reach the overlap
        if lo >= x or len(own) < need:
            continue
        open_ = blocks[lo:x] != blocks[x] if across else np.ones(x - lo, bool)
        if not open_.any():
            continue
        first, last = list_starts[own], list_ends[own]
        span = last - first
        long = min(need - 1, int(need / (MU * np.log2(max(2, span.max())) + 1)))
        by_span = np.argsort(span, kind="stable")
        short, rest = by_span[: len(own) - long], by_span[len(own) - long :]
        merged = np.concatenate([lists[first[i] : last[i]] for i in short])
        count = np.bincount(merged, minlength=n)[lo:x]
        found = np.flatnonzero(open_ & (count >= need - long)) + lo
        if not len(found):
            continue
        overlap = count[found - lo]
        for done, i in enumerate(rest):
            entries = lists[first[i] : last[i]]
            at = np.searchsorted(entries, found)
            overlap = overlap + (entries[np.minimum(at, len(entries) - 1)] == found)
            alive = overlap + (long - done - 1) >= need
            if not alive.all():
                found, overlap = found[alive], overlap[alive]
                if not len(found):
                    break
        good = found[100 * overlap >= percent * (size[x] + size[found] - overlap)] if len(found) else found
        if not len(good):
            continue
        parts, first = np.unique(label[good], return_index=True)
        new = parts != label[x]
        joins = np.zeros(len(good), bool)
        joins[first[new]] = True
        if new.any():
            label[np.isin(label, parts[new])] = label[x]
        links.append((np.full(len(good), order[x]), order[good], joins))
        held += len(good)
        if held >= LINKS_HELD:
            yield tuple(np.concatenate(c) for c in zip(*links, strict=True))
            links, held = [], 0
    if links:
        yield tuple(np.concatenate(c) for c in zip(*links, strict=True))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(doc_id, n_shingles, node, component_id, n_links) for every row, where rows of one node have equal sets and n_links is the
    number of other rows that the row links with; and what gives all links (a, b) between different nodes, each once."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = sets(docs, width, percent)
    grouped = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(grouped, "join-nodes")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size = part.column(1).to_numpy()
                own = [np.frombuffer(k, np.int64) for k in part.column(2).to_pylist()]
                first = [k[: max(0, len(k) - int(least_overlap(s, percent)) + 1)] for k, s in zip(own, size, strict=True)]
                node = part.column(0).take(pa.array(np.repeat(np.arange(len(first)), [len(f) for f in first])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), node], names=["shingle", "node"])

    ties = nodes.select("node", "n", "keys").mapInArrow(lean(prefixes), "shingle long, node binary")
    ties = stored(ties, "join-ties")
    leaders = ties.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z")
    clusters = components(ties.join(leaders, "shingle").select("a", F.col("node").alias("b")).where("a != b").distinct(), "join-clusters")
    dropped(ties)
    member = stored(nodes.join(clusters.select(F.col("v").alias("node"), F.col("root").alias("cluster")), "node").select("cluster", "node", "n", "keys", "copies"), "join-members")
    blocks = member.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("keys") + 64) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = (
        member.join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "keys", "copies")
    )

    def linked(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, i, j), rows in packed.grouped(packed.rows_of(batches), 3):
                block = np.array([r[3] for r in rows])
                if len(rows) < 2 or i != j and (block == block[0]).all():  # links inside a block are found by the block with itself
                    continue
                nodes, copies = pa.array([r[4] for r in rows], pa.binary()), np.array([r[7] for r in rows])
                count = np.zeros(len(rows), np.int64)
                for a, b, joins in search(np.array([r[5] for r in rows]), [np.frombuffer(r[6], np.uint64) for r in rows], block, percent):
                    if whole:
                        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])
                        continue
                    np.add.at(count, a, copies[b])
                    np.add.at(count, b, copies[a])
                    a, b = a[joins], b[joins]
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "links"])
                if not whole:
                    own = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), pa.nulls(len(own), pa.binary()), pa.array(count[own])], names=["a", "b", "links"])

        schema = "a binary, b binary" if whole else "a binary, b binary, links long"
        return dealt.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(lean(run), schema)

    sums = stored(linked(False), "join-links")
    roots = components(sums.where("b is not null").select("a", "b"), "join-components").select(F.col("v").alias("node"), "root")
    counts = sums.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rooted = nodes.select("node", "least", "copies").join(roots, "node", "left").join(counts, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", "n_links")
    alone = found.where("node is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    # a hot set may hold many rows: its rows are dealt out by the engine's own handling of skewed joins
    tied = found.where("node is not null").select("doc_id", "n_shingles", "node").join(least, "node").select(alone.columns)
    return alone.unionByName(tied), lambda: linked(True)
