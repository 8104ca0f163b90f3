"""Language of a text by rank-order profiles (Cavnar and Trenkle, N-Gram-Based Text Categorization, 1994).

A profile is the list of the most frequent n-grams, most frequent first. Those of the languages are
counted over all training texts, those of a document over its whole text. The document gets the
language whose profile is nearest by out-of-place distance: how far apart an n-gram's two ranks are,
summed over the document's profile; an n-gram the language's profile lacks counts its whole length.

N-grams are those of 1 to 3 characters within lower-case words (runs of letters) padded by one
blank on either side. Equal counts are ordered by the characters.

NULL texts and texts without a letter are `und` with score 0, also when nothing was learned; texts
whose language or text is NULL teach nothing. Repeated rows count as often as they occur. Documents
as near to several languages get the first of them by name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import BROADCAST_BYTES, Settled

#: N-grams in a profile. Spark keeps only that many a task and language before the shuffle, up to 1,000.
PROFILE_SIZE = 400
UNKNOWN = "und"
#: Characters taken at once, and n-grams a task counts before it hands them on.
_BLOCK = 1 << 20
_HELD = 1 << 20
_ROWS = 128

_BLANK = 32
# Three code points of 21 bits each in one number; shorter n-grams leave the upper places empty.
_BITS = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _blocks(text: str) -> Iterator[str]:
    """Parts of about a million characters, cut where no letter is cut off its word."""
    start = 0
    while start < len(text):
        end = min(start + _BLOCK, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[start:end] if start or end < len(text) else text
        start = end


def _grams(block: str) -> np.ndarray:
    """Every n-gram of a block, with repeats."""
    points = np.frombuffer(block.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    # Letters, and of what lies between them the first character, as a blank.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inner = np.where(letter, points, _BLANK)[keep]
    line = np.full(len(inner) + 2, _BLANK, np.uint64)
    line[1:-1] = inner
    if len(inner) and inner[-1] == _BLANK:
        line = line[:-1]
    blank = line == _BLANK
    pairs = (line[:-1] << _BITS) | line[1:]
    triples = (pairs[:-1] << _BITS) | line[2:]
    return np.concatenate([line[~blank], pairs[~(blank[:-1] & blank[1:])], triples[~blank[1:-1]]])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of several such pairs as one, n-grams ascending."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return keys, counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text, n-grams ascending."""
    parts = [np.unique(_grams(block), return_counts=True) for block in _blocks(text)]
    return merged(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def profile(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal ones by the characters."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Languages by name, and for every n-gram of any of their profiles its rank in each."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.languages, self.size = sorted(ranked), size
        self.grams = np.array(sorted({g for grams in ranked.values() for g in grams}), np.uint64)
        # What a profile lacks is out of place by its whole length, whatever the document's rank.
        self.ranks = np.full((len(self.grams), len(self.languages)), -1, np.int64)
        for column, language in enumerate(self.languages):
            grams = np.array(ranked[language], np.uint64)
            self.ranks[np.searchsorted(self.grams, grams), column] = np.arange(len(grams))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 less the distance as a share of the largest possible one."""
        own = profile(*gram_counts(text or ""), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[at] == own)
        ranks = self.ranks[at[known]]
        apart = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - known[:, None]), self.size))
        distance = apart.sum(axis=0) + self.size * (len(own) - len(known))
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def language_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all texts, counted within tasks first."""
    schema = "lang STRING, gram BIGINT, n BIGINT"

    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for language, parts in held.items():
            keys, counts = merged(parts)
            columns = [pa.array([language] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
        held.clear()

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = defaultdict(list)
                for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts[language].append(text)
                for language, several in texts.items():
                    counted = gram_counts("\n".join(several))
                    held[language] = [merged([*held.get(language, []), counted])]
                if sum(len(parts[0][0]) for parts in held.values()) > _HELD:
                    yield from rows(held)
        yield from rows(held)

    taught = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = taught.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE
) -> Profiles:
    """The profiles of all languages that `lang_col` names, from all rows of `docs`.

    They meet on the driver: `size` numbers a language. A column with so many values that this is no
    longer small (thousands of them) names no languages, and is an error.
    """
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = language_counts(docs, text_col, lang_col).withColumn("rank", F.row_number().over(first))
    held = Settled(ranked.where(F.col("rank") <= size).select("lang", "gram", "rank"), "profiles")
    if held.bytes() > BROADCAST_BYTES:
        raise ValueError(f"{lang_col} has too many values to be the language of a text")
    grams = defaultdict(list)
    for row in sorted(held.frame.collect(), key=lambda r: r["rank"]):
        grams[row["lang"]].append(row["gram"])
    return Profiles(grams, size)


def identify(
    docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """`docs` with each text's language and score; columns of these two names are replaced."""
    new = {lang_col.lower(), score_col.lower()}
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new or c == text_col))
    names = [c for c in kept.columns if c.lower() not in new]
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, _ROWS):
                texts = batch.column(at).slice(start, _ROWS).to_pylist()
                found.extend(map(shared.value.nearest, texts))
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c.lower() not in new]
            languages = pa.array([language for language, _ in found], pa.string())
            scores = pa.array([score for _, score in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, languages, scores], [*names, lang_col, score_col])

    fields = [f for f in kept.schema.fields if f.name.lower() not in new]
    schema = StructType([*fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    return kept.mapInArrow(run, schema)
