"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text becomes symbols (code points, spaces written as U+2581 and one put in front). Adjacent symbols whose joined form is a
piece wait in an agenda ordered by piece score, then by position; the best pair merges, its neighbours enter the agenda, and
what is left at the end are the tokens. The agendas of many short segments are kept side by side in arrays. Characters without a piece become byte pieces where the vocabulary falls back to
bytes, else the unknown id, one for a run of them.

A merge can only join two characters that stand side by side in some piece. When the vocabulary is loaded it is checked that
no piece holds U+2581 after another character, and which characters share pieces with ASCII digits and signs, directly or in
steps. If no letter does, no merge crosses the border of these signs and all else, and a text is cut there into segments, each merged once and then looked up. A vocabulary that fails a check is cut at less
places, or not at all. Every segment merged is also given to the sentencepiece library, in one call for an Arrow batch, behind
a character of the other kind where it stood behind one; a difference in ids or in decoded text stops the job.

Decoding joins the surfaces of the ids; runs of byte pieces above 0x7F become characters together, or U+FFFD each.

Nulls and empty texts: no tokens but the end id, decoded text "". Very long segments are merged but not kept for later.
Repeated rows and ties of doc_id give a row each, equal for equal texts; an empty table gives an empty result. Other columns
than doc_id and text are neither read nor returned, so clashing names do not matter.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import lean, whole_text

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: What stands before a segment when the library checks one that does not begin with a space.
BEFORE_LETTER, BEFORE_OTHER = ",", "a"
#: Segments kept in memory: two generations of so many each; longer ones than this are not kept.
KEPT_WORDS, KEPT_LENGTH = 250_000, 48
#: Symbols up to which segments are merged side by side; longer ones get a heap each.
SHORT = 32
NEVER = np.int64(1) << 62
#: Rows turned into one output batch.
ROWS = 512


class PieceModel:
    """A merge-type vocabulary, read through the library from the bytes of a model file."""

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or byte[i] for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.cost = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.eos, self.unk = lib.eos_id(), lib.unk_id()
        # a probe character that has no piece tells whether the vocabulary falls back to bytes
        probe = next(chr(c) for c in range(0x10FFFD, 0xF0000, -1) if chr(c) not in self.ids)
        self.byte_fallback = self.unk not in lib.encode(probe)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if byte[i]} if self.byte_fallback else {}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        # symbols are pieces, and after them the characters of pieces that are none; a pair of symbols whose joined form is a piece
        chars = sorted({c for p in self.ids for c in p} - self.ids.keys())
        symbols = self.ids | {c: n + i for i, c in enumerate(chars)}
        self.symbol = np.full(0x110000, -1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        pairs = [(symbols[p[:k]] << 32 | symbols[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.pair_keys, self.pair_made = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        steps = {c: r for r, c in enumerate(sorted(set(self.cost.values())))}
        order = np.zeros(n, np.int64)
        for p, i in self.ids.items():
            order[i] = steps[self.cost[p]]
        self.pair_order = order[self.pair_made] << 32
        self.pieces = n
        self.signs: set[str] = set()
        self.cut = self._cut()
        self.surface = [" ⁇ " if i == self.unk else "" if special[i] else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        # ids whose text depends on nothing but themselves: all but the unknown one and bytes of longer characters
        self.apart = np.array([i != self.unk and self.byte_of.get(i, 0) < 0x80 for i in range(n)])
        self.texts = pa.array([chr(b) if (b := self.byte_of.get(i, 0x80)) < 0x80 else x for i, x in enumerate(self.surface)], pa.large_string())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cut(self) -> re.Pattern | None:
        """What finds the segments that no merge crosses."""
        inner = [p.lstrip(SPACE) for p in self.ids]
        if any(SPACE in p for p in inner):
            return None
        signs, before = {chr(c) for c in range(128) if not chr(c).isalpha()}, 0
        while len(signs) > before:  # what shares a piece with a sign is a sign
            before = len(signs)
            for p in inner:
                if len(p) > 1 and not signs.isdisjoint(p):
                    signs.update(p)
        # without byte pieces a run of unknown characters is one token, which may go on in the next segment
        if any(c.isalpha() for c in signs) or not self.byte_fallback:
            return WORD
        self.signs = signs
        own = "".join(map(re.escape, sorted(signs)))
        return re.compile(f"{SPACE}*[^{own}{SPACE}]+|{SPACE}*[{own}]+|{SPACE}+")

    def _agenda(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols, their place in the order of scores (NEVER if they don't make a piece), and the piece."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_order[at], NEVER), self.pair_made[at]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all segments one after another, and how many each has. Each round takes the first entry of each segment's
        agenda, by score and then by position; segments whose agenda is empty leave."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        segment = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def first_ranks(symbols, segment):
            rank, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)
            if len(symbols) > 1 and len(self.pair_keys):
                rank[:-1], made[:-1] = self._agenda(symbols[:-1], symbols[1:])
                rank[:-1][segment[1:] != segment[:-1]] = NEVER
            return rank, made

        rank, made = first_ranks(symbols, segment)
        while len(symbols):
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            best = np.minimum.reduceat(np.where(rank < NEVER, rank + np.arange(len(rank)), NEVER), starts)
            open_ = best < NEVER
            if not open_.all():
                stays = np.repeat(open_, np.diff(np.append(starts, len(symbols))))
                done.append((segment[~stays], symbols[~stays]))
                moved = np.cumsum(stays) - 1
                symbols, segment, rank, made = symbols[stays], segment[stays], rank[stays], made[stays]
                left = moved[best[open_] & 0xFFFFFFFF]
            else:
                left = best & 0xFFFFFFFF
            if not len(symbols):
                break
            symbols[left] = made[left]
            stays = np.ones(len(symbols), bool)
            stays[left + 1] = False
            symbols, segment, rank, made = symbols[stays], segment[stays], rank[stays], made[stays]
            left -= np.arange(len(left))  # one symbol fewer for each segment before
            for at in (left, left - 1):
                at = at[at >= 0]
                inside = at + 1 < len(symbols)
                inside[inside] = segment[at[inside]] == segment[at[inside] + 1]
                rank[at] = NEVER
                at = at[inside]
                rank[at], made[at] = self._agenda(symbols[at], symbols[at + 1])
        segment, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (segment, symbols)
        by_segment = np.argsort(segment, kind="stable")
        return symbols[by_segment], np.bincount(segment, minlength=len(words))

    def merge_batch(self, words: list[str]) -> list[bytes]:
        """Ids of segments, as the bytes of 32-bit integers."""
        short = [w for w in words if len(w) <= SHORT]
        symbols, sizes = self._merged(short)
        ends = np.cumsum(sizes)
        odd = np.concatenate([[0], np.cumsum((symbols < 0) | (symbols >= self.pieces))])[np.concatenate([[0], ends])]
        data = memoryview(symbols.astype(np.int32).tobytes())
        out = {}
        lo = 0
        for w, hi, strange in zip(short, (ends * 4).tolist(), (np.diff(odd) > 0).tolist(), strict=True):
            out[w] = data[lo:hi].tobytes() if not strange else array("i", self.merge(w)).tobytes()
            lo = hi
        return [out[w] if w in out else array("i", self.merge(w)).tobytes() for w in words]

    def _heaped(self, symbols: list[str]) -> list[str]:
        """Merged symbols of one segment, with a heap of (cost, left, right, length of the pair) as its agenda."""
        cost, n = self.cost, len(symbols)
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, left, right, size = pop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of both has merged with another symbol
            symbols[left], symbols[right] = a + b, ""
            after[left] = k = after[right]
            if k >= 0:
                before[k] = left
                if (c := cost.get(pair := symbols[left] + symbols[k])) is not None:
                    push(agenda, (c, left, k, len(pair)))
            if (k := before[left]) >= 0 and (c := cost.get(pair := symbols[k] + symbols[left])) is not None:
                push(agenda, (c, k, left, len(pair)))
        return [s for s in symbols if s]

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text by the agenda of adjacent pairs."""
        symbols = self._heaped(list(text))
        out: list[int] = []
        unknown = False
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
                unknown = False
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in s.encode("utf-8")]
            else:
                if not unknown:
                    out.append(self.unk)
                unknown = True
        return out

    def checked(self, words: list[str]) -> list[bytes]:
        """Ids of segments as bytes, each equal to the library's."""
        own = self.merge_batch(words)
        plain, front = [], []
        for w in words:
            before = "" if w[0] == SPACE else BEFORE_OTHER if w[0] in self.signs else BEFORE_LETTER
            plain.append(before + w.replace(SPACE, " ") if before else w[1:].replace(SPACE, " "))
            front.append(before)
        heads = {x: array("i", self.merge(SPACE + x)).tobytes() if x else b"" for x in set(front)}
        theirs = self.library.encode(plain, num_threads=1)
        if b"".join([heads[x] + mine for x, mine, text in zip(front, own, plain, strict=True) if text]) != array("i", chain.from_iterable(theirs)).tobytes():
            wrong = next(w for w, x, mine, other, text in zip(words, front, own, theirs, plain, strict=True) if text and heads[x] + mine != array("i", other).tobytes())
            raise RuntimeError(f"ids of {wrong!r} differ from the library's")
        # an end id between them keeps bytes of two segments from making one character
        end = array("i", [self.eos]).tobytes()
        joined = np.frombuffer(end.join(own), np.int32).tolist()
        if joined and self.decode(joined) != self.library.decode(joined):
            raise RuntimeError(f"the decoded text of {words!r} differs from the library's")
        return own

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the bytes of 32-bit integers, without an end id."""
        cut = self.cut.findall if self.cut else lambda t: [t]
        young, old = self.young, self.old
        get = young.get
        rows, new = [], {}
        for t in texts:
            words = cut(SPACE + t.replace(" ", SPACE)) if t else []
            known = list(map(get, words))
            if None in known:
                for w, ids in zip(words, known, strict=True):
                    if ids is None and w not in new:
                        if (ids := old.get(w)) is None:
                            new[w] = b""
                        else:
                            young[w] = ids
                rows.append((words, None))
            else:
                rows.append((words, b"".join(known)))
        new.update(zip(new, self.checked(list(new)), strict=True))
        young.update((w, ids) for w, ids in new.items() if len(w) <= KEPT_LENGTH)
        long = {w: ids for w, ids in new.items() if len(w) > KEPT_LENGTH}
        ids_of = young.__getitem__ if not long else lambda w: young[w] if w in young else long[w]
        out = [b"".join(map(ids_of, words)) if ids is None else ids for words, ids in rows]
        if len(young) > KEPT_WORDS:
            self.young, self.old = {}, young
        return out

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the lists of ids between these offsets."""
        fused = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), self.texts.take(pa.array(ids))), pa.scalar("", pa.large_string())).to_pylist()
        apart = np.concatenate([[0], np.cumsum(~self.apart[ids])])
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if apart[hi] > apart[lo]:
                fused[k] = self.decode(ids[lo:hi].tolist())
            elif fused[k].startswith(" "):
                first = next((i for i in ids[lo:hi].tolist() if i != self.eos), None)
                fused[k] = fused[k][1:] if first not in self.byte_of else fused[k]
        return pa.array(fused, pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one space in front goes, as it was put there by the encoder."""
        surface, byte_of = self.surface, self.byte_of
        if byte_of.keys() & set(ids):
            parts, run = [], bytearray()
            for i in ids:
                if (b := byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_utf8(run))
                    run = bytearray()
                parts.append(surface[i])
            text = "".join(parts) + _utf8(run)
        else:
            text = "".join(map(surface.__getitem__, ids))
        first = next((i for i in ids if i != self.eos), None)
        return text[1:] if first is not None and first not in byte_of and first != self.unk and text.startswith(" ") else text


def _utf8(run: bytearray) -> str:
    """Bytes as text; each byte that is not part of a character becomes U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + n]).decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_MODELS: dict[int, PieceModel] = {}


def _model(model: bytes) -> PieceModel:
    """One model for each worker process."""
    if (key := hash(model)) not in _MODELS:
        _MODELS[key] = PieceModel(model)
    return _MODELS[key]


def encode(docs: DataFrame, model_path: str, add_eos: bool = True) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every text. The model file, of fixed size, is read once by the driver."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        end = np.array([m.eos] if add_eos else [], dtype=np.int32).tobytes()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    rows = [x + end for x in m.encode_batch(part.column(1).to_pylist())]
                    offsets = np.cumsum([0, *(len(x) // 4 for x in rows)])
                    flat = np.frombuffer(b"".join(rows), dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([part.column(0), ids, m.decode_batch(flat, offsets)], names=["doc_id", "ids", "decoded"])
        finally:
            m.young, m.old = {}, {}  # workers live on for other tasks

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(lean(run), f"doc_id {kind}, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
