"""BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

A text is taken apart at its spaces, as no token crosses one. The words so found are counted over
the whole corpus in Spark and the frequent ones encoded once; a minimal automaton that shares
prefixes and suffixes maps each of them to its number (the sum of the outputs along its path, which
works whatever suffixes are shared), and the number to its token ids. The automaton is one flat
block of bytes of bounded size: it is sent to the executors, put in a file there and memory-mapped.

Texts are encoded in blocks of bounded size. Every distinct word of a block is walked through the
automaton, all of them together, a byte a step; those it does not hold are told apart into the
vocabulary's own words and merged exactly, again together, a merge a step.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import most_frequent, settle

#: Words compiled into the automaton, their bytes, and how often a word must occur to be worth it.
LEXICON_WORDS = 100_000
WORD_BYTES = 64
MIN_COUNT = 2
#: Bytes of text that are encoded, or counted, at a time.
ENCODED_BYTES = 2 << 20
COUNTED_BYTES = 4 << 20
#: Words of so many bytes are merged together; longer ones, which are rare, one by one.
_TOGETHER = 32


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints
    (fixed ranges), otherwise the next free character from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A word-level BPE vocabulary file: token ids, merge ranks, splitting pattern, special tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"])
        # (left id, right id) -> rank; rank -> id of the two together.
        known = [(left, right) for left, right in pairs if {left, right, left + right} <= self.ids.keys()]
        self.ranks = {(self.ids[left], self.ids[right]): rank for rank, (left, right) in enumerate(known)}
        self.joined = [self.ids[left + right] for left, right in known]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern["pattern"]["Regex"])
        self.words_and_spaces = regex.compile(f"{pattern['pattern']['Regex']}| ")
        marks = sorted(self.specials, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.parts_at_spaces = not any(" " in mark for mark in marks)
        # Ids of single bytes, within and at the end of a word. Bytes outside the vocabulary have no id
        # and merge with nothing, as it has no unknown token.
        self.within = [self.ids.get(c, -1) for c in _byte_characters()]
        self.at_end = [self.ids.get(c + self.end, -1) for c in _byte_characters()]
        # The same for many words at once: pairs in order, and the ranks of two bytes side by side.
        self._size = max(self.tokens) + 1
        pairs = np.array([left * self._size + right for left, right in self.ranks], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._pair_ranks = pairs[order], np.fromiter(self.ranks.values(), np.int32, len(pairs))[order]
        self._joined = np.array(self.joined, np.int32)
        self._within, self._at_end = np.array(self.within, np.int32), np.array(self.at_end, np.int32)
        self._byte_ranks, self._last_ranks = (
            self._ranks_of(np.repeat(self._within, 256), np.tile(second, 256)).reshape(256, 256)
            for second in (self._within, self._at_end)
        )

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """Parts of texts that can be told apart into words each by itself: no word holds a space."""
        if self.parts_at_spaces:
            return pc.split_pattern(texts, " ")
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; pairs that do not merge have the number of ranks."""
        none = len(self.joined)
        if not none:
            return np.full(len(left), none, np.int32)
        keys = left.astype(np.int64) * self._size + right
        at = np.minimum(np.searchsorted(self._pairs, keys), none - 1)
        return np.where((self._pairs[at] == keys) & (left >= 0) & (right >= 0), self._pair_ranks[at], none).astype(np.int32)

    def merge_together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many per word) of words given as runs of bytes, none of them empty.

        As `merge`, for all words at once: each round makes one merge in every word that has one left.
        """
        none, width = len(self.joined), int(lengths.max())
        column = np.arange(width)
        inside = column < lengths[:, None]
        raw = np.where(inside, data[np.where(inside, starts[:, None] + column, 0)], 0)
        last = column == lengths[:, None] - 1
        ids = np.where(inside, np.where(last, self._at_end[raw], self._within[raw]), -1)
        ranks = np.full((len(starts), width), none, np.int32)
        pair = np.where(last[:, 1:], self._last_ranks[raw[:, :-1], raw[:, 1:]], self._byte_ranks[raw[:, :-1], raw[:, 1:]])
        ranks[:, :-1] = np.where(inside[:, 1:], pair, none)

        done = ids.copy()
        rows = np.arange(len(starts))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best < none
            if not going.all():
                done[rows[~going]] = ids[~going]
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
            if not len(rows):
                break
            one = np.arange(len(rows))
            ids[one, at] = self._joined[best]
            # What follows the pair moves one place to the left; two ranks are new.
            after = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, after, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), axis=1)
            ranks[:, -1] = none
            follows = np.minimum(at + 1, width - 1)
            right = np.where(at + 1 < width, ids[one, follows], -1)
            ranks[one, at] = self._ranks_of(ids[one, at], right)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._ranks_of(ids[before, at[before] - 1], ids[before, at[before]])
        known = done >= 0
        return done[known], known.sum(axis=1)

    def token_table(self) -> pa.Array:
        """The token of every id; NULL where there is none."""
        return pa.array([self.tokens.get(i) for i in range(self._size)], pa.string())

    def all_pieces(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """(pieces, how many per chunk) of many chunks."""
        together = " ".join(chunks)
        if not self.parts_at_spaces or self.marks is not None and self.marks.search(together):
            pieces = list(map(self.pieces, chunks))
            return list(chain.from_iterable(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces))
        found = np.array(self.words_and_spaces.findall(_normal(together)), object)
        space = found == " "
        ends = np.append(np.flatnonzero(space), len(found)) - np.arange(len(chunks))
        return found[~space].tolist(), np.diff(ends, prepend=0)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order; white space goes."""
        if self.marks is None or not self.marks.search(text):
            return self.words.findall(_normal(text))
        parts = self.marks.split(text)
        return [
            piece
            for part in parts
            for piece in ([part] if part in self.specials else self.words.findall(_normal(part)))
        ]

    def merge(self, word: str) -> tuple[int, ...]:
        """Token ids of one word by its merges, lowest rank first, leftmost first among equals."""
        if word in self.specials:
            return (self.specials[word],)
        raw = word.encode("utf-8", "replace")
        ids = [*map(self.within.__getitem__, raw[:-1]), self.at_end[raw[-1]]]
        ids = self._merge_long(ids) if len(ids) > 256 else self._merge_short(ids)
        return tuple(i for i in ids if i >= 0) if -1 in ids else tuple(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The ranks of neighbours in a list, of which a merge changes two."""
        rank_of, none = self.ranks.get, len(self.joined)
        ranks = [rank_of(pair, none) for pair in pairwise(ids)]
        joined = self.joined
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = joined[best]
            del ids[i + 1]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in O(n log n), for words of any length."""
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        queue = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                rank = self.ranks.get((ids[i], ids[after[i]]))
                if rank is not None:
                    heapq.heappush(queue, (rank, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = self.joined[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return ids


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # A capital sigma has one lower case here, wherever in a word it stands.
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """A minimal automaton over the words, in five arrays of 32-bit numbers after a header.

    Built from sorted words by merging each finished branch with an equal one seen before.
    """
    order = sorted(entries)
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}

    def finish(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(nodes)
            nodes.append(key)
        return known[key]

    path = [[False, []]]  # of the word in work: is it final, finished edges
    last = b""
    for word in order:
        same = next((i for i, (x, y) in enumerate(zip(word, last, strict=False)) if x != y), min(len(word), len(last)))
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(*node)))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], finish(*node)))
    root = finish(*path[0])

    below: list[int] = []  # words from a node on; edges lead to nodes finished before
    for final, edges in nodes:
        below.append(final + sum(below[target] for _, target in edges))
    edges_out, final_flags, targets, outputs = [], [], [], []
    for number, (final, edges) in enumerate(nodes):
        passed = int(final)
        final_flags.append(passed)
        for label, target in edges:
            edges_out.append(number << 8 | label)  # ascending, as labels are within a node
            targets.append(target)
            outputs.append(passed)
            passed += below[target]
    starts, ids = [0], []
    for word in order:
        ids.extend(entries[word])
        starts.append(len(ids))
    parts = [array("I", p) for p in (edges_out, final_flags, targets, outputs, starts, ids)]
    head = array("I", [root, max(map(len, order), default=0), *map(len, parts)])
    return b"".join(p.tobytes() for p in (head, *parts))


class Lexicon:
    """The automaton in a memory-mapped file, which has no name any more once it is mapped."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = np.frombuffer(self._map, np.uint32)
        self._root, self._longest, *sizes = map(int, numbers[:8])
        at, parts = 8, []
        for size in sizes:
            parts.append(numbers[at : at + size])
            at += size
        self._edges, self._final, self._targets, self._outputs, self.starts, self.ids = parts

    def get(self, word: bytes) -> tuple[int, ...] | None:
        node, number = self._root, 0
        for byte in word:
            edge = node << 8 | byte
            at = bisect_left(self._edges, edge)
            if at == len(self._edges) or self._edges[at] != edge:
                return None
            number += int(self._outputs[at])
            node = int(self._targets[at])
        if not self._final[node]:
            return None
        return tuple(map(int, self.ids[self.starts[number] : self.starts[number + 1]]))

    def numbers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of words given as runs of bytes, -1 for those it does not hold."""
        node = np.full(len(starts), self._root, np.uint32)
        number = np.zeros(len(starts), np.int64)
        number[lengths > self._longest] = -1
        active = np.flatnonzero(number == 0)
        for step in range(self._longest):
            active = active[lengths[active] > step]
            if not len(active):
                break
            wanted = node[active] << np.uint32(8) | data[starts[active] + step]
            at = np.minimum(np.searchsorted(self._edges, wanted), len(self._edges) - 1)
            found = self._edges[at] == wanted
            number[active[~found]] = -1
            active, at = active[found], at[found]
            node[active] = self._targets[at]
            number[active] += self._outputs[at]
        return np.where(self._final[node] == 1, number, -1)


# One per Python worker, however many batches and tasks it serves.
@lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


@lru_cache(maxsize=2)
def _lexicon(block: bytes) -> Lexicon:
    return Lexicon(block)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of an array of strings."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8), ends[:-1], np.diff(ends)


class Runs:
    """Lists of numbers, one after the other."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray):
        self.starts, self.lengths, self.values = starts, lengths, values

    @classmethod
    def of(cls, lengths: np.ndarray, values: np.ndarray) -> Runs:
        return cls(np.cumsum(lengths) - lengths, lengths, values)

    def take(self, places: np.ndarray) -> Runs:
        """The lists at these places, as lists of their own."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        within = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - lengths), lengths)
        return Runs(ends - lengths, lengths, self.values[within])

    def gathered(self, counts: np.ndarray) -> Runs:
        """Neighbouring lists put together, so many at a time; only for lists without gaps."""
        ends = np.concatenate(([0], np.cumsum(self.lengths)))
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
        return Runs(cuts[:-1], np.diff(cuts), self.values)

    def replaced(self, places: np.ndarray, other: Runs) -> Runs:
        """With the lists at these places replaced by those of `other`."""
        starts, lengths = self.starts.copy(), self.lengths.copy()
        starts[places], lengths[places] = other.starts + len(self.values), other.lengths
        return Runs(starts, lengths, np.concatenate([self.values, other.values]))


class Encoder:
    """Texts to token ids, a block at a time."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self._vocabulary, self._lexicon = vocabulary, lexicon
        self.parts_at_spaces = vocabulary.parts_at_spaces
        self.asked, self.answered = 0, 0  # words of the texts, and those that the automaton holds

    def encode(self, texts: pa.Array) -> Runs:
        """Ids per text. Texts must not be NULL."""
        parted = self._vocabulary.chunks(texts)
        words = parted.flatten().dictionary_encode()
        places = words.indices.to_numpy(zero_copy_only=False)
        held = self._held(words.dictionary)
        unseen = np.flatnonzero(held.lengths < 0)
        self.asked += len(places)
        self.answered += int((held.lengths[places] >= 0).sum())
        if len(unseen):
            held = held.replaced(unseen, self._unseen(words.dictionary.take(pa.array(unseen)).to_pylist()))
        counts = np.diff(parted.offsets.to_numpy())
        return held.take(places).gathered(counts)

    def _held(self, words: pa.Array) -> Runs:
        """Ids by the automaton; a length of -1 for words it does not hold."""
        numbers, starts = self._lexicon.numbers(*_bytes_of(words)), self._lexicon.starts.astype(np.int64)
        known = np.maximum(numbers, 0)
        last = np.minimum(known + 1, len(starts) - 1)
        return Runs(starts[np.minimum(known, len(starts) - 1)], np.where(numbers >= 0, starts[last] - starts[known], -1),
                    self._lexicon.ids.astype(np.int32))

    def _unseen(self, chunks: list[str]) -> Runs:
        pieces, counts = self._vocabulary.all_pieces(chunks)
        words = pa.array(pieces, pa.string()).dictionary_encode()
        held = self._held(words.dictionary)
        rest = np.flatnonzero(held.lengths < 0)
        if len(rest):
            held = held.replaced(rest, self._merged(words.dictionary.take(pa.array(rest))))
        return held.take(words.indices.to_numpy(zero_copy_only=False)).gathered(counts)

    def _merged(self, words: pa.Array) -> Runs:
        data, starts, lengths = _bytes_of(words)
        marks = pa.array(list(self._vocabulary.specials), pa.string())
        special = pc.is_in(words, value_set=marks).to_numpy(zero_copy_only=False)
        alone = special | (lengths > _TOGETHER) | (lengths == 0)
        all_lengths, values = np.zeros(len(words), np.int64), np.zeros(0, np.int32)
        all_starts = np.zeros(len(words), np.int64)
        # Words of like length together, so that rows are not wider than they need be.
        for low, high in ((0, 8), (8, 16), (16, _TOGETHER)):
            few = np.flatnonzero(~alone & (lengths > low) & (lengths <= high))
            if len(few):
                ids, many = self._vocabulary.merge_together(data, starts[few], lengths[few])
                all_lengths[few] = many
                all_starts[few] = np.cumsum(many) - many + len(values)
                values = np.concatenate([values, ids])
        for i in np.flatnonzero(alone):
            ids = np.array(self._vocabulary.merge(words[int(i)].as_py()), np.int32)
            all_lengths[i], all_starts[i] = len(ids), len(values)
            values = np.concatenate([values, ids])
        return Runs(all_starts, all_lengths, values)


def _blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of so many bytes, or of one longer text."""
    ends = np.cumsum(_bytes_of(texts)[2]) if len(texts) else np.zeros(0, np.int64)
    start, before = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, end
        start, before = end, int(ends[end - 1])


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def word_counts(docs: DataFrame, text_col: str, vocabulary: str) -> DataFrame:
    """(word, n) over all texts of the words between spaces that the automaton may hold, counted within blocks first."""

    def run(batches):
        known = _vocabulary(vocabulary)
        for batch in batches:
            texts = _texts(batch.column(0))
            for start, end in _blocks(texts, COUNTED_BYTES):
                counted = known.chunks(texts.slice(start, end - start)).flatten().value_counts()
                words = counted.field("values")
                sizes = pc.binary_length(words)
                usable = pc.and_(pc.greater(sizes, 0), pc.less_equal(sizes, WORD_BYTES))
                yield pa.RecordBatch.from_arrays([words, counted.field("counts")], ["word", "n"]).filter(usable)
                del counted, words
                pa.default_memory_pool().release_unused()

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word STRING, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(
    docs: DataFrame, text_col: str, vocabulary: str, size: int = LEXICON_WORDS, min_count: int = MIN_COUNT
) -> list[str]:
    """The most frequent words of at most 64 bytes, at most `size` of them."""
    counts = settle(word_counts(docs, text_col, vocabulary).where(F.col("n") >= min_count), "word-counts")
    return [word for word, _ in most_frequent(counts, size)]


def build_lexicon(words: list[str], vocabulary: str) -> bytes:
    known = _vocabulary(vocabulary)
    return compile_lexicon({
        word.encode("utf-8", "replace"): tuple(chain.from_iterable(map(known.merge, known.pieces(word)))) for word in words
    })


def encode(
    docs: DataFrame, vocabulary: str, lexicon: bytes, text_col: str = "text", ids_col: str = "ids",
    decoded_col: str | None = None, keep_text: bool = True,
) -> DataFrame:
    """`docs` with `ids_col` ARRAY<INT>: the whole text's token ids; a column of that name is replaced.

    NULL or empty texts have none. Texts longer than a block are encoded in parts, cut at spaces.
    With `decoded_col` the ids are decoded at once, as by `decode` but by the same Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, lexicon))
    new = {c.lower() for c in (ids_col, decoded_col) if c}
    rows = _without(docs, new, text_col)
    read = rows.columns
    at, names = read.index(text_col), [c for c in read if c.lower() not in new and (keep_text or c != text_col)]
    made = [ids_col, *([decoded_col] if decoded_col else [])]

    def encoded(encoder: Encoder, texts: pa.Array) -> Runs:
        if len(texts) > 1 or _bytes_of(texts)[2][0] <= ENCODED_BYTES:
            return encoder.encode(texts)
        parts = [encoder.encode(pa.array([part], pa.string())) for part in _parts(texts[0].as_py(), encoder)]
        return Runs.of(np.array([sum(int(p.lengths[0]) for p in parts)]), np.concatenate([p.values for p in parts]))

    def run(batches):
        spec, block = shared.value
        known, encoder = _vocabulary(spec), Encoder(_vocabulary(spec), _lexicon(block))
        table = known.token_table()
        for batch in batches:
            texts = _texts(batch.column(at))
            for start, end in _blocks(texts, ENCODED_BYTES):
                ids = encoded(encoder, texts.slice(start, end - start))
                values = ids.values.astype(np.int32)
                ends = pa.array(np.append(ids.starts, len(values)).astype(np.int32))
                added = [pa.ListArray.from_arrays(ends, pa.array(values))]
                if decoded_col:
                    added.append(_decoded(table, values, ids.lengths))
                part = batch.slice(start, end - start)
                columns = [part.column(i) for i, c in enumerate(read) if c in names]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, *made])
                pa.default_memory_pool().release_unused()

    # A map over batches, not a UDF: Spark would run a UDF anew inside each one that reads its ids.
    fields = [f for f in rows.schema.fields if f.name in names] + [StructField(ids_col, ArrayType(IntegerType()))]
    if decoded_col:
        fields.append(StructField(decoded_col, StringType()))
    return rows.mapInArrow(run, StructType(fields))


def _decoded(table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of lists of ids, given one after the other."""
    known = (ids >= 0) & (ids < len(table))
    tokens = table.take(pa.array(np.where(known, ids, 0)))
    known &= tokens.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)[known]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(counts))))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.filter(pa.array(known))), " ")


def _parts(text: str, encoder: Encoder) -> Iterator[str]:
    """A long text in parts that end before a space; the space itself is no word."""
    step, start = ENCODED_BYTES // 4, 0
    while start < len(text):
        end = text.find(" ", start + step) if encoder.parts_at_spaces else -1
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def _without(docs: DataFrame, new: set[str], but: str) -> DataFrame:
    """`docs` without the columns that are to be made, unless that is the one they are made from."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new or c == but))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`docs` with `text_col`: the tokens of the ids, parted by a space, special tokens included.

    That is what the vocabulary's library gives where a vocabulary names no decoder. NULL ids give
    an empty text; ids outside the vocabulary give nothing. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = _without(docs, {text_col.lower()}, ids_col)
    read = rows.columns
    at, names = read.index(ids_col), [c for c in read if c.lower() != text_col.lower()]

    def run(batches):
        table = _vocabulary(shared.value).token_table()
        for batch in batches:
            lists = pc.fill_null(batch.column(at), pa.scalar([], batch.column(at).type))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum(sizes) // (ENCODED_BYTES // 4)))))
            for start, end in pairwise([*cuts, batch.num_rows]):
                ids = lists.slice(start, end - start).flatten().to_numpy(zero_copy_only=False)
                part = batch.slice(start, end - start)
                columns = [part.column(i) for i, c in enumerate(read) if c in names]
                yield pa.RecordBatch.from_arrays([*columns, _decoded(table, ids, sizes[start:end])], names=[*names, text_col])

    fields = [f for f in rows.schema.fields if f.name in names]
    return rows.mapInArrow(run, StructType([*fields, StructField(text_col, StringType())]))


def read_vocabulary(path: str) -> str:
    """Vocabulary files are small and lie beside the installed tokenizers, on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()
