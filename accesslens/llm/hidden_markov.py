"""A hidden Markov language model over a corpus of any size.

States emit word classes and classes emit words:

    P(word | state) = P(class | state) * P(word | class)

The most frequent words are classes of their own; the others share classes by a hash of their
last letters. The class parameters have a fixed size, so that Baum-Welch can run over the whole
corpus: each round, every task runs forward and backward over its documents, and its expected
counts are summed in Spark. P(word | class) comes from the counts of all training words, a table
that grows with the corpus and is only ever joined to, never collected. As it does not depend on
the state, the likelihood of a text is exact: scaled forward recursion over its classes, plus a
sum over its words.

Words among the most frequent ones (a bounded list, sent to the tasks) are resolved where the
text is read; only the others are joined, and none of those can be hot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import most_frequent, settle

STATES = 8
#: Words with a class of their own, classes shared by the others, words resolved without a join.
OWN_CLASSES, SHARED_CLASSES, RESOLVED_WORDS = 1024, 1024, 65_536
#: Baum-Welch rounds at most, each over all training documents, and the share of the log likelihood
#: that a round must gain for another one to follow.
ROUNDS = 14
LEAST_GAIN = 1e-3

_END = OWN_CLASSES + SHARED_CLASSES  # the class of the token that ends a text
CLASSES = _END + 1
_WORDS_HELD = 200_000
_TEXTS_AT_ONCE = 512
#: Tokens that a step of the recursions is held for at once, and of texts side by side, ends filled up.
_TOKENS_AT_ONCE = 50_000
_CELLS = 1_500_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # A-Z only; parts at \\x20 and \\x09-\\x0D


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the training texts, counted within tasks first."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        held = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > _WORDS_HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    counted = texts.where("NOT held_out").select("text").mapInArrow(run, "word BINARY, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _shared_class(word: bytes) -> int:
    return OWN_CLASSES + zlib.crc32(word[-3:]) % SHARED_CLASSES


@dataclass
class Lexicon:
    """What tasks know of the training words: the most frequent ones, and sums over all of them."""

    counts: dict[bytes, int]  # most frequent first
    tokens: int
    distinct: int
    documents: int
    class_total: np.ndarray  # log10 of the denominator of P(word | class)

    def classes(self) -> dict[bytes, int]:
        return {word: i for i, word in zip(range(OWN_CLASSES), self.counts, strict=False)}


def lexicon(counts: DataFrame, documents: int) -> Lexicon:
    frequent = {bytes(word): n for word, n in most_frequent(counts, RESOLVED_WORDS)}
    own = {word: i for i, word in zip(range(OWN_CLASSES), frequent, strict=False)}

    def run(batches):
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = own.get(word)
                at = _shared_class(word) if at is None else at
                n[at] += count
                v[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["at", "n", "v"])

    sums = counts.mapInArrow(run, "at BIGINT, n BIGINT, v BIGINT").groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for at, total, distinct in sums.collect():
        n[at], v[at] = total, distinct
    totals = n + 0.5 * (v + 1)
    # A class of one word is that word: the two terms of its probability cancel.
    totals[:OWN_CLASSES] = n[:OWN_CLASSES] + 0.5
    totals[_END] = documents + 0.5
    return Lexicon(frequent, int(n.sum()) + documents, int(v.sum()) + (documents > 0), documents, np.log10(totals))


_CODED = (
    "row BIGINT, doc_id {kind}, held_out BOOLEAN, n_tokens BIGINT, known BIGINT, log_counts DOUBLE, "
    "log_totals DOUBLE, classes BINARY, rare ARRAY<STRUCT<word: BINARY, n: INT>>"
)


def code(texts: DataFrame, known: Lexicon) -> DataFrame:
    """Each text as class numbers, with sums over the words resolved here and a list of the others."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        lex = shared.value
        own = lex.classes()
        logs = dict(zip(lex.counts, np.log10(np.array([*lex.counts.values(), 1]) + 0.5).tolist(), strict=False))
        end_log = float(np.log10(lex.documents + 0.5))
        for batch in batches:
            texts = batch.column(3)
            for first in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                few = [words_of(text) for text in texts.slice(first, _TEXTS_AT_ONCE).to_pylist()]
                # Each distinct word once: its class, and the logarithm of its count where that is known here.
                words = pa.array(list(chain.from_iterable(few)), pa.binary()).dictionary_encode()
                places = words.indices.to_numpy(zero_copy_only=False)
                distinct = words.dictionary.to_pylist()
                class_of = np.array([_shared_class(w) if (at := own.get(w)) is None else at for w in distinct], np.uint16)
                log_of = np.array([logs.get(w, np.nan) for w in distinct])
                found = log_of[places]
                known_here, found = ~np.isnan(found), np.nan_to_num(found)
                lengths = np.array(list(map(len, few)))
                of_text = np.repeat(np.arange(len(few)), lengths)

                # Words and, after each text's, its end.
                tokens = np.full(len(places) + len(few), _END, np.uint16)
                tokens[np.arange(len(places)) + of_text] = class_of[places]
                cuts = np.cumsum(lengths + 1)
                totals = np.add.reduceat(lex.class_total[tokens], cuts - lengths - 1)

                # The others, counted per text.
                pairs, times = np.unique(of_text[~known_here] * len(distinct) + places[~known_here], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(few) + 1) * len(distinct))
                rare = words.dictionary.take(pa.array(pairs % max(1, len(distinct))))
                rare = pa.StructArray.from_arrays([rare, pa.array(times.astype(np.int32))], ["word", "n"])

                def per_text(values, base, of_text=of_text, few=few):
                    return np.bincount(of_text, values, len(few)) + base

                part = batch.slice(first, _TEXTS_AT_ONCE)
                columns = [
                    *part.columns[:3],
                    pa.array(lengths + 1, pa.int64()),
                    pa.array(per_text(known_here, lex.documents > 0).astype(np.int64)),
                    pa.array(per_text(found, end_log)),
                    pa.array(totals),
                    pa.array([t.tobytes() for t in np.split(tokens, cuts[:-1])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rare),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns,
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "log_counts", "log_totals", "classes", "rare"],
                )

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("row", "doc_id", "held_out", "text").mapInArrow(run, _CODED.format(kind=kind))


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @staticmethod
    def random(seed: int = 0) -> Model:
        chance = np.random.default_rng(seed)
        emit = chance.gamma(1.0, size=(CLASSES, STATES)) + 0.5
        move = chance.gamma(1.0, size=(STATES, STATES)) + 0.5 + 8 * np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def single(self) -> Model:
        return Model(*(part.astype(np.float32) for part in (self.start, self.move, self.emit)))

    @staticmethod
    def from_counts(flat: np.ndarray) -> Model:
        start, move, emit, _ = _parts(flat)
        start, move, emit = start + 0.1, move + 0.1, emit + 0.02
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


_SIZE = STATES + STATES * STATES + CLASSES * STATES + 1


def _parts(flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, move, emission counts and log likelihood, as views of one vector."""
    a, b = STATES, STATES + STATES * STATES
    return flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:-1].reshape(CLASSES, STATES), flat[-1:]


def _groups(texts: list[np.ndarray]):
    """Lists of indexes of texts of like length, longest first, of bounded size when padded."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        width = max(1, _CELLS // len(texts[order[at]]))
        yield order[at : at + width]
        at += width


class _Padded:
    """Texts sorted by falling length, side by side: a column each, a step of all of them at a time."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.steps, self.columns = int(lengths[0]), len(texts)
        self.seen = np.zeros((self.steps, self.columns), np.uint16)
        for i, text in enumerate(texts):
            self.seen[: len(text), i] = text
        # Texts longer than t, for every step t and the one after the last.
        self.active = np.searchsorted(-lengths, -np.arange(self.steps + 1), "left")

    def blocks(self) -> list[tuple[int, int]]:
        """Runs of steps whose arrays are of bounded size, however long the texts are."""
        cuts = [0]
        while cuts[-1] < self.steps:
            cuts.append(min(cuts[-1] + max(1, _TOKENS_AT_ONCE // self.active[cuts[-1]]), self.steps))
        return list(pairwise(cuts))


def _forward(model: Model, padded: _Padded, first: int, last: int, before: np.ndarray | None):
    """Scaled forward recursion over the steps [first, last), from the state probabilities before them.

    Emissions and state probabilities are (states, steps, texts); a text that has ended has zeros.
    """
    kind = model.emit.dtype
    emit, move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    width = padded.active[first]
    seen = padded.seen[first:last, :width].astype(np.intp)
    emitted = np.take(emit, seen, axis=1, mode="clip")
    alpha = np.zeros_like(emitted)
    scale = np.ones((last - first, width), kind)
    for t in range(last - first):
        n = padded.active[first + t]
        now = emitted[:, t, :n] * (model.start[:, None] if before is None else move @ before[:, :n])
        total = now.sum(axis=0)
        np.divide(now, total, out=alpha[:, t, :n])
        scale[t, :n] = total
        before = alpha[:, t, :]
    return emitted, alpha, scale


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each sequence of classes."""
    out = np.zeros(len(texts))
    for group in _groups(texts):
        padded, before = _Padded([texts[i] for i in group]), None
        for first, last in padded.blocks():
            _, alpha, scale = _forward(model, padded, first, last, before)
            before = alpha[:, -1, :].copy()
            out[group[: scale.shape[1]]] += np.log10(scale).sum(axis=0)
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch: expected starts, moves and emissions over the texts, and their log10 likelihood.

    Texts too long to be held as a whole go through block by block: forward once to know the states
    at each block's start, then backward, each block forward once more.
    """
    flat = np.zeros(_SIZE)
    for group in _groups(texts):
        padded = _Padded([texts[i] for i in group])
        blocks = padded.blocks()
        held, befores = [], [None]
        for first, last in blocks:
            held.append(_forward(model, padded, first, last, befores[-1]))
            befores.append(held[-1][1][:, -1, :].copy())
            if padded.steps * padded.columns > _CELLS:
                held[-1] = None  # one very long text
        after = np.zeros((STATES, 0), model.emit.dtype)
        for (first, last), before, forward in reversed(list(zip(blocks, befores, held, strict=False))):
            after = _add_block(flat, model, padded, first, forward or _forward(model, padded, first, last, before), after)
            held.pop()
    return flat


def _add_block(flat, model: Model, padded: _Padded, first: int, forward: tuple, after: np.ndarray) -> np.ndarray:
    """Add a block's counts; `after`, and what is returned, is emission times beta over scale of the step that follows."""
    start, move, emit, likelihood = _parts(flat)
    emitted, alpha, scale = forward
    emitted /= scale
    beta, later = np.ones_like(alpha), np.zeros_like(alpha)
    for t in range(len(scale) - 1, -1, -1):
        n = after.shape[1]
        later[:, t, :n] = after
        np.matmul(model.move, after, out=beta[:, t, :n])
        n = padded.active[first + t]
        after = emitted[:, t, :n] * beta[:, t, :n]
    move += alpha.reshape(STATES, -1) @ later.reshape(STATES, -1).T * model.move
    alpha *= beta  # now the probabilities of the states given the whole text
    if first == 0:
        start += alpha[:, 0, :].sum(axis=1)
    seen = padded.seen[first : first + len(scale), : alpha.shape[2]].ravel()
    for state in range(STATES):
        emit[:, state] += np.bincount(seen, alpha[state].ravel(), CLASSES)
    likelihood += np.log10(scale).sum(dtype=float)
    return after


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16) for b in column.to_pylist()]


def train(
    coded: DataFrame, documents: int, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN,
    told: list[float] | None = None,
) -> Model:
    """Baum-Welch from a random model; every round counts over all training documents.

    Ends after `rounds`, or as soon as a round's log10 likelihood exceeds the one before by less than
    `least_gain` of it. `told` is given each round's, of the model that the round started from.
    """
    training = coded.where("NOT held_out")
    model, likelihoods = Model.random(), [] if told is None else told
    for _ in range(rounds if documents else 0):
        flat = _counts(training, model)
        model = Model.from_counts(flat)
        likelihoods.append(float(flat[-1]))
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < least_gain * abs(likelihoods[-2]):
            break
    return model


def _counts(training: DataFrame, model: Model) -> np.ndarray:
    """Expected counts summed over tasks in Spark; what arrives has the fixed size of the model."""
    # Single precision for the recursions of a round; sums over texts are double.
    shared = training.sparkSession.sparkContext.broadcast(model.single())

    def run(batches):
        flat = np.zeros(_SIZE)
        for batch in batches:
            flat += expected_counts(shared.value, _sequences(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SIZE)), pa.array(flat)], names=["at", "n"])

    parts = training.select("classes").mapInArrow(run, "at BIGINT, n DOUBLE")
    flat = np.zeros(_SIZE)
    for at, n in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[at] = n
    return flat


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) mod 5 is not 1; a NULL id is learned from. NULL
    texts count as empty: one token, the end. Rows that repeat an id are scored, and counted, each
    for itself. Without training documents all words are unknown. Other columns are ignored.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    counts = settle(word_counts(texts), "word-counts")
    known = lexicon(counts, texts.where("NOT held_out").count())
    coded = settle(code(texts, known), "coded")
    model = train(coded, known.documents, rounds)

    rare = (
        coded.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", F.col("r.n").alias("times"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "log_counts", "log_totals"]

    def run(batches):
        for batch in batches:
            logs = log_likelihoods(shared.value, _sequences(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs)], names=[*kept, "forward"])

    schema = StructType([*coded.select(*kept).schema.fields, StructField("forward", DoubleType())])
    scored = coded.select(*kept, "classes").mapInArrow(run, schema).join(rare, "row", "left")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    whole = float(np.log10(known.tokens + 0.5 * (known.distinct + 1)))
    return scored.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("forward") + logs - F.col("log_totals")).alias("score"),
    )
