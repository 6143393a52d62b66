"""Chunks of tokenised documents: local word numbers and 64-bit hashes of the words, as one compressed row each.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, with A to Z in lower case. Null texts are empty.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, stored, whole_text
from corpusloom.llm.packed import expand, squeeze

#: UTF-8 bytes of text after which a chunk is closed.
CHUNK_BYTES = 3_000_000


def tokens(data: bytes) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, and split at exactly these six bytes."""
    return data.lower().split()


def chunked(docs: DataFrame, flag: Column, name: str) -> DataFrame:
    """Stored rows (chunk long, docs long, words long, body binary); flag is a boolean that goes with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def fresh():
            vocabulary: dict[bytes, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            return vocabulary, [], [], [], 0

        vocabulary, ids, flags, found, size = fresh()

        def closed() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
            lengths = np.array([len(f) for f in found], np.int64)
            words = np.concatenate(found) if found else np.empty(0, np.int32)
            body = pickle.dumps((ids, np.array(flags, bool), squeeze(lengths), squeeze(words), hashes.tobytes()), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([body], pa.binary())], names=["chunk", "docs", "words", "body"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, yes, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    own = tokens(text)
                    found.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
                    ids.append(doc_id)
                    flags.append(bool(yes))
                    size += len(text) + 16
                    if size >= CHUNK_BYTES:
                        yield closed()
                        number += 1
                        vocabulary, ids, flags, found, size = fresh()
        if ids:
            yield closed()

    rows = docs.select("doc_id", flag.alias("flag"), whole_text().cast("binary").alias("text"))
    return stored(rows.mapInArrow(lean(run), "chunk long, docs long, words long, body binary"), name)


def extent(chunks: DataFrame) -> tuple[int, int]:
    """Number of chunks, and of all words."""
    row = chunks.agg(F.count(F.lit(1)), F.sum("words")).first()
    return row[0], row[1] or 0


def opened(body: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, flags, number of words of each document, local word numbers, hashes by local number)."""
    ids, flags, lengths, words, hashes = pickle.loads(body)
    return ids, flags, expand(lengths, np.int64), expand(words, np.int32), np.frombuffer(hashes, np.uint64)
