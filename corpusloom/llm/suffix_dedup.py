"""Removal of repeated passages, by a distributed difference-cover algorithm.

A passage is a string of WIDTH bytes that starts at two places or more, of one document or of several. As in suffix sorting
by difference covers (Kaerkkaeinen, Sanders and Burkhardt, 2006), only the suffixes at sampled offsets are sorted first: the
offsets that modulo v lie in a perfect difference set (Singer, 1938), about 9 % of them. For any two places there is a shift
below v that makes both sampled, so two equal passages hold an equal string of WIDTH - v + 1 bytes at a sampled offset.

1. Sampled tuples of about v bytes get names: 64-bit fingerprints, sorted over the corpus (packed.py), equal neighbours
   counted. A name that occurs once is settled and goes (discarding, after Dementiev et al., 2008); documents without others
   are done.
2. Recursion on names: sampled offsets stay sampled when v is added, so the name of a longer string is the tuple of the names
   of its parts, v apart. Names of WIDTH - v bytes and of WIDTH bytes are sorted the same way; those of WIDTH bytes that occur
   twice or more cover their bytes.
3. Remaining suffixes can only matter where they start less than v before a sampled name that is left, and where their
   passage is not covered yet. The names beside such places are marked, over all their occurrences, with the distances at
   which these suffixes start.
4. The suffixes that start at a marked distance before an occurrence of the name are merged by their first WIDTH bytes, and
   neighbours in that order with equal prefixes cover the rest.

The order is that of fingerprints, since equality of prefixes is all that is asked for. Names of 1 and the shorter ones of 2
only filter. Strings that decide (WIDTH bytes, in 2 and 4) are compared by two independent fingerprints, 96 bits: two
different ones are taken for equal with a probability of n^2 / 2^97 for n strings. The bytes themselves are not sent. A frequent
passage costs each chunk of the corpus one entry, however often it occurs, and no group of occurrences meets in one task.

Beside that, passages of `words` words are reported: passages of 50 words are mostly shorter than 400 bytes. They are runs
of bytes that are removed, or lie in a string of WIDTH - v bytes which starts with a word at two places and holds no removed
byte. For these, steps 2 to 4 run with the shorter names too, where nothing of WIDTH bytes is found nearby; one fingerprint decides.

Nulls and empty texts have no bytes. Texts shorter than WIDTH stay whole; longer ones are read whole, in overlapping pieces.
Repeated rows and exact copies of WIDTH bytes or more go wholly, each of them; all of a tie's places go alike. Passages never
cross documents. An empty table gives an empty result. Other columns than doc_id and text are not read, so clashing names do
not matter. Chunks of documents are a stored table: a repeated or lost task reads the same chunks again.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import packed
from corpusloom.llm.common import dropped, lean, released, stored, whole_text
from corpusloom.llm.packed import M1, mixed

WIDTH, ORDER = 400, 11
#: Words of a run that is reported as a passage.
PASSAGE_WORDS = 50
#: UTF-8 bytes after which a chunk of documents is closed, and bytes looked at together.
CHUNK_BYTES, PIECE = 4_000_000, 1 << 19
NAMES, MIDDLE, LONG, SUFFIXES, SUFFIXES_SHORT = range(5)
MARKED, MARKED_SHORT = packed.MASKS, packed.MASKS + 1
#: Distances that share a bit of a mask.
STEP = 3
SCHEMA = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, starts array<long>, ends array<long>, kept_text string"


def difference_cover(q: int) -> tuple[int, list[int]]:
    """(v, perfect difference set modulo v = q^2 + q + 1) for a prime q: exponents at which powers of an element of GF(q^3)
    fall into a plane. The first cubic that gives one is taken."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
                    return v, [s - found[0] for s in found]  # the beginning of a text is sampled
    raise ValueError(f"no perfect difference set for {q}")


#: Odd bases of both polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
#: Bytes between words.
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: What each byte counts in either hash.
_BYTES = [mixed(np.arange(256, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1) for salt in (7, 311)]


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (np.uint64(b), np.uint64(pow(b, -1, 1 << 64)))) for b in _BASES]
    return _POWERS


def fingerprints(data: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Fingerprints of the strings of this length at rising offsets of data, alike wherever a string stands. which: of the two hashes."""
    out = np.empty(len(at), np.uint64)
    edges = np.searchsorted(at, np.arange(0, len(data) + PIECE, PIECE))
    power, inverse = _powers(PIECE + length + 1)[which]
    for piece in range(len(edges) - 1):
        lo, hi = edges[piece], edges[piece + 1]
        if lo == hi:
            continue
        first = piece * PIECE
        own = at[lo:hi] - first
        values = _BYTES[which][data[first + own[0] : first + own[-1] + length]]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)])])
        own = own - own[0]
        out[lo:hi] = mixed((sums[own + length] - sums[own]) * inverse[own])
    return out


class Texts:
    """Documents of a chunk laid end to end, with the sampled offsets and those of suffixes that are long enough."""

    def __init__(self, texts: bytes, lengths: np.ndarray, cover: tuple[int, list[int]], width: int):
        self.data, self.lengths, self.width = np.frombuffer(texts, np.uint8), lengths, width
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.v, self.cover = cover
        self.parts = max(2, width // self.v)  # parts of a name of full width
        self.short = width - (self.parts - 1) * self.v
        self.middle = width - self.v
        self.at = self._sampled()
        self._names: dict[int, np.ndarray] = {}

    def end_of(self, at: np.ndarray) -> np.ndarray:
        """End of the document that holds each offset."""
        return self.ends[np.searchsorted(self.ends, at, side="right")]

    def start_of(self, at: np.ndarray) -> np.ndarray:
        return self.starts[np.searchsorted(self.ends, at, side="right")]

    def _sampled(self) -> np.ndarray:
        """Sampled offsets at which a tuple fits, rising."""
        room = self.lengths - self.short + 1
        out = []
        for start, n in zip(self.starts.tolist(), room.tolist(), strict=True):
            if n > 0:
                rounds = -(-n // self.v)
                own = (np.arange(rounds)[:, None] * self.v + np.array(self.cover)[None, :]).reshape(-1)
                out.append(own[own < n] + start)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def tuples(self, which: int = 0) -> np.ndarray:
        """Names of the tuples at all sampled offsets."""
        if which not in self._names:
            self._names[which] = fingerprints(self.data, self.at, self.short, which)
        return self._names[which]

    def fits(self, at: np.ndarray, length: int) -> np.ndarray:
        return at[at + length <= self.end_of(at)] if len(at) else at

    def named(self, at: np.ndarray, parts: int, which: int = 0) -> np.ndarray:
        """Names of short + (parts - 1) v bytes at these sampled offsets, from the names of their parts."""
        names = self.tuples(which)
        out = names[np.searchsorted(self.at, at)]
        for k in range(1, parts):
            out = mixed(out * M1 + names[np.searchsorted(self.at, at + k * self.v)])
        return out

    def last(self, left: np.ndarray, width: int) -> np.ndarray:
        """Offsets of the last strings of this width of the documents that have a name left."""
        own = np.unique(np.searchsorted(self.ends, left, side="right"))
        return self.ends[own][self.lengths[own] >= width] - width

    def joined(self, at: np.ndarray, which: int = 0) -> np.ndarray:
        """What `named` gives at full width, at any offsets."""
        out = fingerprints(self.data, at, self.short, which)
        for k in range(1, self.parts):
            out = mixed(out * M1 + fingerprints(self.data, at + k * self.v, self.short, which))
        return out

    def room(self, width: int, words: bool = False) -> np.ndarray:
        """Whether a passage of this width fits at each offset; words: and a word begins there."""
        delta = np.zeros(len(self.data) + 1, np.int8)
        long = self.lengths >= width
        delta[self.starts[long]] += 1
        delta[self.ends[long] - width + 1] -= 1
        out = np.cumsum(delta[:-1], dtype=np.int8) > 0
        if words:
            space = _SPACES[self.data]
            out &= ~space
            out[1:] &= space[:-1]
            out[self.starts[long]] = ~space[self.starts[long]]
        return out

    def before(self, at: np.ndarray, masks: np.ndarray, width: int, words: bool = False) -> np.ndarray:
        """Offsets at the marked distances before these, in the same document, where a passage fits (see room). Rising."""
        found = np.zeros(len(self.data), bool)
        at, masks = at[masks > 0], masks[masks > 0]
        for distance in range(self.v):
            own = at[(masks >> (distance // STEP)) & 1 == 1] - distance
            found[own[own >= 0]] = True
        # what lies before the beginning of the document does not fit in the one before: at least width - v bytes follow the name
        return np.flatnonzero(found & self.room(width, words))

    def covered(self, at: np.ndarray, width: int) -> np.ndarray:
        """Whether each byte lies in a passage of this width that starts at one of these."""
        delta = np.zeros(len(self.data) + 1, np.int32)
        delta[at] += 1  # offsets differ
        delta[at + width] -= 1
        return np.cumsum(delta[:-1], dtype=np.int32) > 0

    def unsettled(self, left: np.ndarray, taken: np.ndarray, width: int, words: bool = False) -> np.ndarray:
        """Of the sampled offsets left, a mask of the distances less than v before them at which a passage starts that is not
        wholly taken (words: that begins with a word, and of which nothing is taken). taken: of each byte."""
        if not len(left) or len(self.data) < width:
            return np.zeros(len(left), np.int64)
        total = np.concatenate([[0], np.cumsum(taken, dtype=np.int32)])
        share = total[width:] - total[:-width]
        open_ = self.room(width, words)
        open_[: len(share)] &= share == 0 if words else share < width
        count, out = np.concatenate([[0], np.cumsum(open_, dtype=np.int32)]), np.zeros(len(left), np.int64)
        beside = np.flatnonzero(count[left + 1] > count[np.maximum(left - self.v + 1, 0)])
        own = left[beside]
        for bit in range(-(-self.v // STEP)):
            nearest = own - bit * STEP
            farthest = np.maximum(nearest - STEP + 1, own - self.v + 1)
            out[beside] |= (count[np.maximum(nearest + 1, 0)] > count[np.maximum(farthest, 0)]).astype(np.int64) << bit
        return out


def _checked(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted different keys, their checks of 32 bits, the place of each, how often each occurs)."""
    checks = checks >> np.uint64(32)
    every, first, place, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    own = checks[first]
    if len(keys) and not (own[place] == checks).all():
        both, place, counts = np.unique(np.stack([keys, checks], axis=1), axis=0, return_inverse=True, return_counts=True)
        every, own, place = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), place.reshape(-1)
    return every, own, place, counts


def chunked(docs: DataFrame) -> DataFrame:
    """Stored rows (chunk long, bytes long, body binary) of the documents' whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([_body(ids, texts)], pa.binary())], names=["chunk", "bytes", "body"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text) + 16
                    if size >= CHUNK_BYTES:
                        yield closed()
                        number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield closed()

    return stored(docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(lean(run), "chunk long, bytes long, body binary"), "suffix-chunks")


def _body(ids: list, texts: list[bytes]) -> bytes:
    """A chunk: ids, lengths, compressed text, and the offsets known so far."""
    return pickle.dumps((ids, np.array([len(t) for t in texts], np.int64), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), {}), protocol=5)


def _with(body: bytes, **offsets: np.ndarray) -> bytes:
    """The chunk with offsets that were found, rising."""
    *rest, known = pickle.loads(body)
    return pickle.dumps((*rest, known | {k: packed.pack_keys(x.astype(np.uint64)) for k, x in offsets.items()}), protocol=5)


def _opened(body: bytes, cover: tuple[int, list[int]], width: int) -> tuple[list, Texts, dict[str, np.ndarray]]:
    """(ids, texts, offsets by name)."""
    ids, lengths, data, known = pickle.loads(body)
    t = Texts(zstandard.ZstdDecompressor().decompress(data) if lengths.sum() else b"", lengths, cover, width)
    return ids, t, {k: packed.unpack_keys(x).astype(np.int64) for k, x in known.items()}


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of the bytes that go, those of characters all of whose bytes go."""
    first = (data & 0xC0) != 0x80
    character = np.cumsum(first) - 1
    return (np.bincount(character, weights=~gone) == 0)[character] if len(data) else gone


def runs(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that go."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def passages(data: np.ndarray, shared: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Runs of shared bytes that hold at least so many words."""
    return [(a, z) for a, z in zip(*(x.tolist() for x in runs(shared)), strict=True) if len(data[a:z].tobytes().split()) >= words]


def _row(doc_id, data: np.ndarray, gone: np.ndarray | None, shared: np.ndarray | None, words: int, texts: bool) -> tuple:
    """Result of one document; gone: whether each byte goes; shared: whether it goes or lies in a shorter string that occurs twice."""
    long = passages(data, shared, words) if words and shared is not None and shared.any() else []
    removed = np.zeros(len(data), bool) if gone is None else gone
    if texts:
        lost = removed.copy()
        for a, z in long:
            lost[a:z] = True
        text = (data[~whole_characters(data, lost)] if lost.any() else data).tobytes().decode("utf-8")
    starts, ends = runs(removed) if removed.any() else (np.empty(0, int),) * 2
    kept = data[~removed] if len(starts) else data
    return doc_id, len(data), int(removed.sum()), len(starts), hashlib.sha256(kept.tobytes()).hexdigest(), len(long), starts.tolist(), ends.tolist(), text if texts else None


def spans(docs: DataFrame, width: int = WIDTH, order: int = ORDER, texts: bool = False, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and the removed runs as starts and ends, for each document.
    n_passages counts the passages of at least `words` words (0: none are looked for). With texts, kept_text: what is left when passages and removed bytes go, by whole characters."""
    spark = docs.sparkSession
    cover = difference_cover(order)
    if cover[0] >= width:
        raise ValueError("the cover's modulus must be below the width")
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_text", pa.string())]
    result = pa.schema(fields)
    chunks = chunked(docs)
    n_chunks, size = chunks.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if -(-cover[0] // STEP) > 63:
        raise ValueError("the cover's modulus must fit a mask")
    # sampled tuples only filter, so a part of their bits is enough; a document has hundreds of them
    bits = packed.bits_for((size or 0) * len(cover[1]) // cover[0], 16)
    cut = np.uint64(64 - bits)

    def table_of(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(result), result, strict=True)]

    def counted(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(names, return_inverse=True)

    # 1: names of sampled tuples
    def send_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, body in packed.rows_of(batches):
            names, counts = np.unique(_opened(body, cover, width)[1].tuples() >> cut, return_counts=True)
            yield packed.sent(NAMES, chunk, names, counts, bits)

    def keep_names(row: tuple, sums: dict) -> pa.RecordBatch:
        chunk, body = row
        ids, t, _ = _opened(body, cover, width)
        left = np.zeros(0, bool)
        if len(t.at):
            left = sums[NAMES][counted(t.tuples() >> cut)[1]] >= 2
        holds = np.zeros(len(ids), bool)
        holds[np.searchsorted(t.ends, t.at[left], side="right")] = True
        done, kept_ids, kept = [], [], []
        for i, doc_id in enumerate(ids):
            data = t.data[t.starts[i] : t.ends[i]]
            if holds[i]:
                kept_ids.append(doc_id)
                kept.append(data.tobytes())
            else:
                done.append(_row(doc_id, data, None, None, words, texts))
        columns = [*table_of(done), pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.binary())]
        if kept:
            # offsets among the documents that go on
            left = t.at[left]
            doc = np.searchsorted(t.ends, left, side="right")
            before = np.cumsum(np.where(holds, 0, t.lengths))
            own = _with(_body(kept_ids, kept), left=left - before[doc])
            more = [*(pa.nulls(1, f.type) for f in result), pa.array([chunk], pa.int64()), pa.array([own], pa.binary())]
            columns = [pa.concat_arrays([a, b]) for a, b in zip(columns, more, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*result.names, "chunk", "body"])

    names = stored(packed.answered(chunks.select("chunk", "body").mapInArrow(lean(send_names), packed.SENT), n_chunks, bits), "suffix-names")
    released(spark)
    first = stored(packed.with_answers(chunks, names, keep_names, f"{SCHEMA.format(id=kind)}, chunk long, body binary"), "suffix-first")
    dropped(names, chunks)
    released(spark)
    bodies = first.where("body is not null").select("chunk", "body")
    done = first.where("body is null").select(*result.names)

    # 2: longer names from these; parts - 1 of them for the middle length, all for the full one
    def middle_names(t: Texts, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = t.fits(left, t.middle)
        return at, t.named(at, t.parts - 1)

    def long_names(t: Texts, left: np.ndarray):
        """Offsets that are sampled or the last of a document, and their names of full width. The last strings settle the ends
        of copies."""
        long = t.fits(left, width)
        last = np.setdiff1d(t.last(left, width), long)
        keys, checks = (np.concatenate([t.named(long, t.parts, k), t.joined(last, k)]) for k in (0, 1))
        return np.concatenate([long, last]), _checked(keys, checks)

    def send_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, body in packed.rows_of(batches):
            _, t, known = _opened(body, cover, width)
            keys, counts = np.unique(middle_names(t, known["left"])[1], return_counts=True)
            yield packed.sent(MIDDLE, chunk, keys, counts)
            keys, checks, _, counts = long_names(t, known["left"])[1]
            yield packed.sent(LONG, chunk, keys, counts, checks=checks)

    lengthened = stored(packed.answered(bodies.mapInArrow(lean(send_long), packed.SENT), n_chunks), "suffix-long")
    released(spark)

    # steps 3 and 4 give rows to send and, in one more row, the chunk with the offsets found
    both = f"{packed.SENT}, body binary"

    def sending(sent: list[pa.RecordBatch], chunk: int, body: bytes) -> Iterator[pa.RecordBatch]:
        for batch in sent:
            yield batch.append_column("body", pa.nulls(batch.num_rows, pa.binary()))
        schema = sent[0].schema
        yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) if f.name != "chunk" else pa.array([chunk], f.type) for f in schema] + [pa.array([body], pa.binary())], names=[*schema.names, "body"])

    def bodies_of(table: DataFrame) -> DataFrame:
        return table.where("body is not null").select("chunk", "body")

    def answers_of(table: DataFrame, name: str) -> DataFrame:
        return stored(packed.answered(table.where("body is null").drop("body"), n_chunks), name)

    # 3: names beside passages that are not settled
    def send_marked(row: tuple, sums: dict) -> Iterator[pa.RecordBatch]:
        chunk, body = row
        _, t, known = _opened(body, cover, width)
        left = known["left"]
        middle, names = middle_names(t, left)
        if len(middle):
            twice = sums[MIDDLE][counted(names)[1]] >= 2
            middle, names = middle[twice], names[twice]
        long, (_, _, place, _) = long_names(t, left)
        if len(long):
            long = np.sort(long[sums[LONG][place] >= 2])
        taken = t.covered(long, width)
        sent = []
        for what, at, own, length in ((MARKED, middle, names, width), (MARKED_SHORT, left, t.named(left, 1), t.middle))[: 2 if words else 1]:
            keys, place = counted(own)
            sent.append(packed.sent(what, chunk, keys, packed.totals(what, place, t.unsettled(at, taken, length, what == MARKED_SHORT), len(keys))))
        yield from sending(sent, chunk, _with(body, middle=middle, long=long))

    third = stored(packed.with_answers(bodies, lengthened, send_marked, both), "suffix-third")
    dropped(lengthened)
    marked = answers_of(third, "suffix-marked")
    released(spark)

    # 4: remaining suffixes by their whole prefix
    def suffix_names(t: Texts, at: np.ndarray):
        return _checked(fingerprints(t.data, at, width), fingerprints(t.data, at, width, 1))

    def send_suffixes(row: tuple, sums: dict) -> Iterator[pa.RecordBatch]:
        chunk, body = row
        _, t, known = _opened(body, cover, width)
        left, middle = known["left"], known["middle"]
        long = t.before(middle, sums[MARKED][counted(t.named(middle, t.parts - 1))[1]], width) if len(middle) else middle
        short = t.before(left, sums[MARKED_SHORT][counted(t.named(left, 1))[1]], t.middle, True) if words and len(left) else left[:0]
        keys, checks, _, counts = suffix_names(t, long)
        sent = [packed.sent(SUFFIXES, chunk, keys, counts, checks=checks)]
        keys, counts = np.unique(fingerprints(t.data, short, t.middle), return_counts=True)
        sent.append(packed.sent(SUFFIXES_SHORT, chunk, keys, counts))
        yield from sending(sent, chunk, _with(body, suffixes=long, short=short))

    fourth = stored(packed.with_answers(bodies_of(third), marked, send_suffixes, both), "suffix-fourth")
    dropped(third, marked)
    released(spark)
    merged = answers_of(fourth, "suffix-merged")
    released(spark)

    def finish(row: tuple, sums: dict) -> pa.RecordBatch:
        ids, t, known = _opened(row[1], cover, width)
        long, short = known["suffixes"], known["short"]
        if len(long):
            long = long[sums[SUFFIXES][suffix_names(t, long)[2]] >= 2]
        if len(short):
            short = short[sums[SUFFIXES_SHORT][counted(fingerprints(t.data, short, t.middle))[1]] >= 2]
        gone = t.covered(np.concatenate([known["long"], long]), width)
        total = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
        shared = gone | t.covered(short[total[short + t.middle] == total[short]], t.middle)
        rows = [_row(doc_id, t.data[a:z], gone[a:z], shared[a:z], words, texts) for doc_id, a, z in zip(ids, t.starts.tolist(), t.ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(table_of(rows), schema=result)

    rest = stored(packed.with_answers(bodies_of(fourth), merged, finish, SCHEMA.format(id=kind)), "suffix-rest")
    dropped(fourth, merged)
    return done.unionByName(rest)
