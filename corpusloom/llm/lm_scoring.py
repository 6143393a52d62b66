"""Scoring by a weighted backoff automaton over word n-grams.

States are histories: the empty one, single words (one of them the beginning of a text), and pairs of words that the training
texts hold at least LEAST times. A state has an arc for each word seen after its history, whose weight is the log10 of the
smoothed probability, and a failure arc to the state of the history without its first word. Counts are smoothed by a Dirichlet
prior on the shorter history (MacKay and Peto, 1995),

    p(w | u v) = (c(u v w) + K p(w | v)) / (c(u v) + K),    p(w | v) = (c(v w) + K p(w)) / (c(v) + K),
    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

so a failure arc weighs K / (c(history) + K), and the probabilities of a state sum to one. The empty state has an arc for every
word. An arc leads to the state of the longest history that ends with its word.

One traversal reads a text from left to right and carries the state: it takes failure arcs until the state has an arc for the
token, takes that, and adds up the weights (`Automaton.walk`). A worker builds the part of the automaton that the documents of
a chunk can reach, walks them, and drops it, so memory doesn't grow with the model.

Counts are taken over all training documents: each chunk sends its words and pairs once with their counts (packed.py), then
the triples that start with a pair that is a state, and gets back the sums for exactly the arcs that its texts can take.
Nothing of the size of the model is broadcast; the driver gets N and V.

Nulls and empty texts are the end token alone; a null doc_id counts as an empty id. Repeated rows count again, and ties of
doc_id are scored each by its own text. Very long texts are read whole. An empty table gives an empty result; with no training
tokens, N and V are 0. Other columns than doc_id and text are not read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import packed
from corpusloom.llm.common import dropped, lean, released, stored
from corpusloom.llm.packed import M1, M2, M3, mixed
from corpusloom.llm.words import chunked, extent, opened

#: Hashes of the end of a text, and of the history before its first word.
END, BEGIN = np.uint64(0x656E64), np.uint64(0x626567696E)
#: Strength of the prior: tokens that the shorter history counts for in each history.
PRIOR = 50.0
#: Occurrences of a pair of words that is a state.
LEAST = 2
WORD, PAIR, TRIPLE = 0, 1, 2
SCHEMA = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Automaton:
    """States are numbers: 0 the empty history, up to `words` those of one word, above it pairs. Arcs are (weights, next states):
    those of single words by the number of the pair that history and token make, those of pairs by the number of the triple,
    failure arcs by state, and those of the empty history by token."""

    def __init__(self, words: int, pair_arcs: tuple[list, list], triple_arcs: tuple[list, list], failure: tuple[list, list], empty: tuple[list, list]):
        self.words, self.pair_arcs, self.triple_arcs, self.failure, self.empty = words, pair_arcs, triple_arcs, failure, empty

    def walk(self, state: int, tokens: list[int], pairs: list[int], triples: list[int]) -> float:
        """log10 probability of the tokens, read from this state on. pairs and triples: for each token, the number of the arc that
        it takes from the word before and from the two words before, -1 where there is none."""
        words, total = self.words, 0.0
        (pair_weight, pair_state), (triple_weight, triple_state) = self.pair_arcs, self.triple_arcs
        (failure_weight, failure_state), (empty_weight, empty_state) = self.failure, self.empty
        for token, pair, triple in zip(tokens, pairs, triples, strict=True):
            if state > words:
                if triple >= 0:
                    total += triple_weight[triple]
                    state = triple_state[triple]
                    continue
                total += failure_weight[state]
                state = failure_state[state]
            if state:
                if pair >= 0:
                    total += pair_weight[pair]
                    state = pair_state[pair]
                    continue
                total += failure_weight[state]
                state = failure_state[state]
            total += empty_weight[token]
            state = empty_state[token]
        return total


class Grams:
    """Words, pairs and triples of a chunk: for each, the sorted different keys, the place of each token's key among them, and
    training counts. A text's tokens end with the end token; before its first one stands the beginning."""

    def __init__(self, body: bytes):
        self.ids, self.held, lengths, words, hashes = opened(body)
        hashes = np.append(hashes, [END, BEGIN])
        end, begin = len(hashes) - 2, len(hashes) - 1
        tokens = np.insert(words.astype(np.int64), np.cumsum(lengths), end)
        self.lengths = lengths + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        history = np.empty_like(tokens)
        history[1:] = tokens[:-1]
        history[self.starts] = begin
        self.train = np.repeat(~self.held, self.lengths)
        order = np.argsort(hashes[:-1], kind="stable")  # the begin is no token
        place = np.empty(len(hashes), np.int64)
        place[order] = np.arange(len(order))
        place[begin] = place[end]  # as many texts begin as end
        self.begin, self.end = len(order), place[end]
        self.word_keys, self.word = hashes[:-1][order], place[tokens]
        self.history = place[history]
        # the beginning is told from the end as a history by a number of its own
        self.before = np.where(history == begin, self.begin, self.history)
        pairs, inverse = np.unique(history * len(hashes) + tokens, return_inverse=True)
        keys = mixed(hashes[pairs // len(hashes)] * M1 + hashes[pairs % len(hashes)] * M2)
        by_key = np.argsort(keys, kind="stable")
        rank = np.empty(len(pairs), np.int64)
        rank[by_key] = np.arange(len(pairs))
        self.pair_keys, self.pair = keys[by_key], rank[inverse]
        self.pair_before = np.empty_like(self.pair)  # the pair that ends where this one's second word begins
        self.pair_before[1:] = self.pair[:-1]
        self.pair_before[self.starts] = -1

    def counts(self, place: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(place[self.train], minlength=n)

    def triples(self, pair_sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the text at which a triple ends that starts with a state, sorted different keys, the place of each among these)."""
        at = np.flatnonzero((self.pair_before >= 0) & (pair_sums[self.pair_before] >= LEAST))
        keys, place = np.unique(mixed(self.pair_keys[self.pair_before[at]] * M3 + self.word_keys[self.word[at]] * M1), return_inverse=True)
        return at, keys, place


def automaton(g: Grams, sums: dict[int, np.ndarray], n: int, v: int, prior: float) -> tuple[Automaton, np.ndarray, np.ndarray]:
    """The part of the automaton that a chunk can reach, and the numbers of the pair and triple arcs by token. Its states are the
    empty history, then words (the beginning last), then pairs."""
    words, pairs = g.begin + 1, len(g.pair_keys)
    count, pair_count = sums[WORD].astype(float), sums[PAIR].astype(float)
    unigram = (count + 0.5) / (n + 0.5 * (v + 1))
    history_count = np.append(count, count[g.end])  # as many texts begin as end
    word_state = np.where(count > 0, 1 + np.arange(len(count)), 0)
    first, second = np.empty(pairs, np.int64), np.empty(pairs, np.int64)
    first[g.pair], second[g.pair] = g.before, g.word
    bigram = (pair_count + prior * unigram[second]) / (history_count[first] + prior)
    # the state of the longest history that ends with a pair's second word; the end of a text is no history
    after = np.where((pair_count >= LEAST) & (second != g.end), 1 + words + np.arange(pairs), word_state[second])
    at, keys, place = g.triples(sums[PAIR])
    one = np.empty(len(keys), np.int64)  # a place in the text for each triple
    one[place] = at
    last = g.pair[one]
    triple_count = sums[TRIPLE].astype(float) if len(keys) else np.empty(0)
    trigram = (triple_count + prior * bigram[last]) / (pair_count[g.pair_before[one]] + prior)
    listed = lambda weight, state: (np.log10(weight).tolist(), state.tolist())
    failure = listed(prior / (np.concatenate([[0.0], history_count, pair_count]) + prior), np.concatenate([np.zeros(1 + words, np.int64), np.where(second == g.end, 0, 1 + second)]))
    pair = np.where(pair_count[g.pair] > 0, g.pair, -1)
    triple = np.full(len(g.word), -1)
    triple[at] = np.where(triple_count[place] > 0, place, -1) if len(at) else at
    return Automaton(words, listed(bigram, after), listed(trigram, after[last]), failure, listed(unigram, word_state)), pair, triple


def score(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    chunks = chunked(docs, held_out, "lm-chunks")
    n_chunks, _ = extent(chunks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, body in packed.rows_of(batches):
            g = Grams(body)
            yield packed.sent(WORD, chunk, g.word_keys, g.counts(g.word, len(g.word_keys)))
            yield packed.sent(PAIR, chunk, g.pair_keys, g.counts(g.pair, len(g.pair_keys)))

    answers = stored(packed.answered(chunks.select("chunk", "body").mapInArrow(lean(send), packed.SENT), n_chunks), "lm-answers")
    released(spark)
    total = answers.where(F.col("kind") == WORD).agg(F.sum("counts_total"), F.sum("keys_total")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)

    def send_triples(row: tuple, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        chunk, body = row
        g = Grams(body)
        at, keys, place = g.triples(sums[PAIR])
        return packed.sent(TRIPLE, chunk, keys, np.bincount(place[g.train[at]], minlength=len(keys)))

    pairs = answers.where(F.col("kind") == PAIR)
    triples = stored(packed.answered(packed.with_answers(chunks, pairs, send_triples, packed.SENT), n_chunks), "lm-triples")
    released(spark)
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()

    def made(row: tuple, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        g = Grams(row[1])
        count = sums[WORD][g.word]
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        model, pair, triple = automaton(g, sums, n, v, prior)
        cuts = [slice(a, a + m) for a, m in zip(g.starts.tolist(), g.lengths.tolist(), strict=True)]
        scores = [model.walk(1 + g.begin, g.word[c].tolist(), pair[c].tolist(), triple[c].tolist()) for c in cuts]
        add = lambda x: np.add.reduceat(x, g.starts)
        return pa.RecordBatch.from_arrays(
            [pa.array(g.ids, id_type), pa.array(g.held), pa.array(g.lengths), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(g.ids), n, np.int64)), pa.array(add(base)), pa.array(scores, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    out = stored(packed.with_answers(chunks, answers.unionByName(triples), made, SCHEMA.format(id=kind)), "lm-scores")
    dropped(chunks, answers, triples)
    return out
