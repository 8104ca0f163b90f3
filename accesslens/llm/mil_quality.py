"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 50 words. Every passage is encoded (surface statistics, then a
learned layer), a gated attention, exp(w . (tanh(V h) * sigmoid(U h))) normalised over the bag,
weighs the passages, and the weighted mean of their encodings is scored by a logistic unit
(Ilse, Tomczak, Welling, 2018). All weights are learned from document labels alone.

Training takes a bounded sample of the labelled documents; scoring covers every passage of every
document, one batch of rows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 50
#: Labelled documents used for training at most: those with the smallest hashes of their ids.
SAMPLE_DOCS = 4096

_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
# Classes of bytes: lower, upper, digit, space, line end, control, beyond ASCII, each sign its own.
_CLASS = np.full(256, 5)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[128:] = 3, 4, 6
_CLASS[_PUNCTUATION] = 7 + np.arange(len(_PUNCTUATION))
_CLASSES = 7 + len(_PUNCTUATION)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_WORDLIKE = (_CLASS == 0) | (_CLASS == 1) | (_CLASS == 6)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FEATURES = _CLASSES + 10


def passages(text: bytes | None) -> np.ndarray:
    """One row of features per passage; a text without words is one passage of zeros."""
    raw = np.frombuffer(text or b"", np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else raw
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    lengths = (ends - starts).astype(float)
    of_word = np.arange(len(starts)) // PASSAGE_WORDS
    n = int(of_word[-1]) + 1
    words = np.bincount(of_word, minlength=n)

    opens = starts[::PASSAGE_WORDS].copy()
    opens[0] = 0
    of_byte = np.repeat(np.arange(n), np.diff(np.append(opens, len(raw))))
    signs = np.bincount(of_byte * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    signs = np.log1p(100 * signs / signs.sum(axis=1, keepdims=True))

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, values, n) / words

    # Words are told apart by a hash of their bytes and places within the word.
    opened = np.zeros(len(raw), np.int64)
    opened[starts] = starts
    spots = (np.arange(len(raw)) - np.maximum.accumulate(opened)).astype(np.uint64)
    weights = (raw.astype(np.uint64) + np.uint64(1)) * (spots + np.uint64(3)) * _MULTIPLIER
    weights ^= weights >> np.uint64(29)
    hashes = np.add.reduceat(np.where(space, np.uint64(0), weights * _MULTIPLIER), starts)
    order = np.lexsort((hashes, of_word))
    new = np.concatenate(([True], (np.diff(hashes[order]) != 0) | (np.diff(of_word[order]) != 0)))
    groups = np.flatnonzero(new)
    runs = np.diff(np.append(groups, len(order)))
    most = np.zeros(n)
    np.maximum.at(most, of_word[order[groups]], runs)
    average = mean(lengths)
    rest = [
        np.log1p(words) / 4,
        average / 10,
        np.sqrt(np.maximum(0, mean(lengths**2) - average**2)) / 10,
        np.bincount(of_word[order[groups]], minlength=n) / words,
        most / words,
        mean(_ENDS[raw[ends - 1]].astype(float)),
        mean((~_WORDLIKE[raw[starts]]).astype(float)),
        mean((~_WORDLIKE[raw[ends - 1]]).astype(float)),
        mean((lengths <= 3).astype(float)),
        mean((_CLASS[raw[starts]] == 1).astype(float)),
    ]
    return np.hstack([signs, np.stack(rest, axis=1)]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights of the encoder, the two attention gates and the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (t * g) @ w["a"]
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        raised = np.exp(logit - np.maximum.reduceat(logit, starts)[of])
        share = raised / np.add.reduceat(raised, starts)[of]
        z = np.add.reduceat(share[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "of": of, "share": share, "z": z,
                "score": _sigmoid(z @ w["c"] + w["b"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self._forward(np.concatenate(bags), starts)["score"].astype(float)

    def _gradient(self, x, starts, labels) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x, starts)
        d = (f["score"] - labels) / len(labels)
        dz = d[:, None] * w["c"]
        per = dz[f["of"]]
        pull = (per * f["h"]).sum(axis=1)
        dlogit = f["share"] * (pull - np.add.reduceat(f["share"] * pull, starts)[f["of"]])
        dgate = dlogit[:, None] * w["a"]
        dt, dg = dgate * f["g"] * (1 - f["t"] ** 2), dgate * f["t"] * f["g"] * (1 - f["g"])
        dh = per * f["share"][:, None] + dt @ w["V"].T + dg @ w["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dpre, "e": dpre.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "a": (f["t"] * f["g"]).T @ dlogit, "c": f["z"].T @ d, "b": np.array(d.sum())}


def fit(bags: list[np.ndarray], labels: np.ndarray, size: int = 24, gate: int = 12, epochs: int = 40) -> Model:
    """Adam on the logistic loss, the same weights for the same bags in the same order."""
    random = np.random.default_rng(0)
    everything = np.concatenate(bags)
    shapes = {"E": (FEATURES, size), "e": (size,), "V": (size, gate), "U": (size, gate), "a": (gate,), "c": (size,), "b": ()}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s) if s else np.array(0.0) for k, s in shapes.items()}
    model = Model(everything.mean(axis=0), everything.std(axis=0) + 1e-3, weights)
    first = {k: np.zeros(s) for k, s in shapes.items()}
    second = {k: np.zeros(s) for k, s in shapes.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            own = [bags[i] for i in chosen]
            gradient = model._gradient(np.concatenate(own), np.cumsum([0, *map(len, own[:-1])]), labels[chosen])
            step += 1
            for k, d in gradient.items():
                d = d + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                rate = 0.01 * (1 - epoch / epochs)
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample_docs: int = SAMPLE_DOCS,
) -> Model | None:
    """A model from at most `sample_docs` labelled documents outside the held-out third.

    Labels are 0 or 1, others and NULL teach nothing; of labels or documents that repeat an id one
    counts. Without any label there is no model.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))
    )
    one = known.groupBy("id").agg(F.max("label").alias("label"))
    sample = one.orderBy(F.xxhash64("id"), "id").limit(sample_docs)

    def run(batches):
        for batch in batches:
            rows = [passages(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "bag": rows})

    kind = dict(known.dtypes)["id"]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # One text per id before anything is collected, whatever rows repeat it.
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    found = chosen.mapInPandas(run, f"id {kind}, label INT, bag BINARY").collect()
    if not found:
        return None
    found.sort(key=lambda r: str(r["id"]))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, FEATURES) for r in found]
    return fit(bags, np.array([r["label"] for r in found], float))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1, higher where label 1 is likelier. NULL counts as empty,
    and an empty text is scored like any other. Without a model every score is 0.5."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        known, out, bags, held = shared.value, [], [], 0
        for text in texts:
            bags.append(passages(text))
            held += len(bags[-1])
            if held >= 20_000:
                out.extend(known.scores(bags))
                bags, held = [], 0
        if bags:
            out.extend(known.scores(bags))
        return pd.Series(out, dtype=float)

    return docs.withColumn(score_col, score_of(F.col(text_col).cast("binary")))
