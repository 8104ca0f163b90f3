"""The highest-scoring documents of each item, from a tree of frequency-ordered term vectors.

A document's vector is restricted to terms of the items and ordered by document frequency, most
frequent first; documents that begin alike share a path of a prefix tree (Han, Pei, Yin, Mining
Frequent Patterns without Candidate Generation, 2000). Every node knows, for its subtree, each
term's largest tf and the smallest length norm m; as a term's part of the score grows with tf and
falls with m, the two bound the score of every document below. Each item then goes depth first
through the tree, best child first, and leaves out subtrees whose bound cannot reach its k best.

Documents stay in the partition they are read in: a task builds a tree of some hundred documents at
a time and carries the items' k best from tree to tree, and the tasks' best meet at last, at most k
per item and task. Items are taken in blocks of a bounded number of (item, term) pairs.

Score: sum over the item's terms of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with
w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 * n * N) div L.

Ids are integers. Rows of `docs` are documents, whatever their ids: repeated rows are found as often
as they occur, NULL ids come last among equal scores. Rows of `items` with the same id (NULL is one)
are one item with the terms of all of them. Texts that are NULL or without a term match nothing.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled

#: (item, term) pairs of a block of items.
BLOCK_PAIRS = 20_000
#: Documents of a tree, and entries (nodes by terms) that its table may have at most.
TREE_DOCS = 1024
TREE_CELLS = 8 << 20
#: Documents a task gathers, so that those of like length share a tree.
GATHERED_DOCS = 8192
#: A node of so few documents is not divided further.
LEAF_DOCS = 32

# One byte each: A-Z to a-z, other term bytes as they are, everything else a blank. In UTF-8 the bytes
# from 0x80 on belong to characters beyond ASCII, all of which are term characters.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text with repeats, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""

    def run(batches):
        for batch in batches:
            pairs = [
                (item, term.decode("utf-8", "replace"))
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for term in set(terms(text))
            ]
            columns = [pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "term"])

    chosen = items.select(F.col(item_col).cast("bigint"), F.col(text_col).cast("string"))
    return chosen.mapInArrow(run, "item BIGINT, term STRING").distinct()


def vectors(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tfs) of documents with a term: places in the vocabulary and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    chosen = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))

    def run(batches):
        place = {term.encode(): i for i, term in enumerate(shared.value)}
        for batch in batches:
            sizes, rows, places, tfs, ends = [], [], [], [], [0]
            texts = batch.column(1)
            for i in range(batch.num_rows):
                found = terms(texts[i].as_py())
                if not found:
                    continue
                held = Counter(filter(place.__contains__, found))
                rows.append(i)
                sizes.append(len(found))
                places.extend(map(place.__getitem__, held))
                tfs.extend(held.values())
                ends.append(len(places))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (places, tfs)]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    return chosen.mapInArrow(run, "doc BIGINT, n BIGINT, terms ARRAY<INT>, tfs ARRAY<INT>")


# Ids negated, so that the smaller of two is the worse one; NULL is worst.
_NULL = -(1 << 63) - 1


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The prefix tree of some documents, each (m, key, term ranks ascending, tfs)."""

    def __init__(self, docs: list[tuple[int, int | None, np.ndarray, np.ndarray]], width: int):
        # Documents in the order of their paths: a node is a run of them, [low, high).
        paths = [ranks.astype(">u4").tobytes() for _, _, ranks, _ in docs]
        order = sorted(range(len(docs)), key=paths.__getitem__)
        paths = [paths[i] for i in order]
        self.keys = [_NULL if docs[i][1] is None else -docs[i][1] for i in order]
        m = np.array([docs[i][0] for i in order], np.int64)
        self.children: list[list[int]] = []
        self.runs: list[tuple[int, int]] = []
        self._divide(paths)
        # Of every node, in one column each: the largest tf of each term below, the smallest m.
        nodes = len(self.runs)
        self.impacts = np.zeros((width, len(docs)), np.int32)
        most = np.zeros((nodes, width), np.int32)
        for at, i in enumerate(order):
            _, _, ranks, tfs = docs[i]
            self.impacts[ranks, at] = impact(tfs.astype(np.int64), m[at])
        least = np.empty(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):  # children come after their parent
            low, high = self.runs[node]
            least[node] = m[low:high].min()
            if self.children[node]:
                most[node] = most[self.children[node]].max(axis=0)
            else:
                for at in range(low, high):
                    _, _, ranks, tfs = docs[order[at]]
                    most[node, ranks] = np.maximum(most[node, ranks], tfs)
        self.bounds = np.zeros((width, nodes), np.int32)
        where, what = np.nonzero(most)
        self.bounds[what, where] = impact(most[where, what].astype(np.int64), least[where])

    def _divide(self, paths: list[bytes]) -> None:
        """Nodes from the root on: a run whose paths part at some term has a child per term."""
        todo = [(0, len(paths), 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            node = len(self.runs)
            self.runs.append((low, high))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low <= LEAF_DOCS or paths[low] == paths[high - 1]:
                continue
            one, other = paths[low], paths[high - 1]
            while one[depth : depth + 4] == other[depth : depth + 4]:  # an unbranched stretch is one node
                depth += 4
            start = low
            for at in range(low + 1, high + 1):
                if at == high or paths[at][depth : depth + 4] != paths[start][depth : depth + 4]:
                    todo.append((start, at, depth, node))
                    start = at

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list, k: int) -> None:
        """Put the item's best documents into the heap `best` of (score, id negated)."""
        bounds = weights @ self.bounds[ranks]
        if bounds[0] <= 0:
            return
        todo = [0]
        while todo:
            node = todo.pop()
            if len(best) == k and bounds[node] < best[0][0] or bounds[node] <= 0:
                continue
            if self.children[node]:
                todo.extend(sorted(self.children[node], key=bounds.__getitem__))  # the best comes off first
                continue
            low, high = self.runs[node]
            scores = weights @ self.impacts[ranks, low:high]
            least = best[0][0] if len(best) == k else 1
            for at in np.flatnonzero(scores >= max(least, 1)):
                entry = (int(scores[at]), self.keys[low + at])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _read(batches) -> Iterator[tuple[int | None, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        places, tfs = lists.values.to_numpy(), batch.column(3).values.to_numpy()
        for i, key in enumerate(ids):
            part = slice(ends[i], ends[i + 1])
            yield key, int(sizes[i]), places[part], tfs[part]


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id",
    text_col: str = "text", block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """(item, rank INT, doc, score BIGINT) under the names of the id columns: each item's k best documents.

    Scores above 0 only, equal ones by ascending document id.
    """
    pairs = Settled(item_terms(items, item_col, text_col), "item-terms").frame
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    block_of = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for block in range(blocks):
        rows = pairs.where(block_of == block).collect() if blocks > 1 else pairs.collect()
        best = _best(docs, rows, k, id_col, text_col)
        found = best if found is None else found.unionByName(best)
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _best(docs: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc, score): for each item of a block at most k rows a task, its k best among them."""
    spark = docs.sparkSession
    vocabulary = sorted({row["term"] for row in rows})
    held = Settled(vectors(docs, vocabulary, id_col, text_col), "term-vectors").frame
    totals = held.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    counted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    dfs = {row["term"]: row["df"] for row in counted.collect()}
    # Ranks by document frequency; terms of no document have none.
    ordered = sorted(dfs, key=lambda term: (-dfs[term], term))
    rank = np.full(len(vocabulary), -1, np.int64)
    rank[ordered] = np.arange(len(ordered))
    weights = np.array([weight(n_docs, dfs[term]) for term in ordered], np.int64)
    place = {term: i for i, term in enumerate(vocabulary)}
    wanted: dict = {}
    for row in rows:
        at = rank[place[row["term"]]]
        if at >= 0:
            wanted.setdefault(row["item"], []).append(at)
    queries = [(item, np.array(sorted(ranks), np.int64)) for item, ranks in wanted.items()]
    shared = spark.sparkContext.broadcast((rank, weights, queries))
    width = len(ordered)
    per_tree = max(LEAF_DOCS, min(TREE_DOCS, TREE_CELLS // max(1, 2 * width)))

    def run(batches):
        ranks_of, weight_of, items = shared.value
        heaps: list[list] = [[] for _ in items]

        def grow(gathered: list) -> None:
            gathered.sort(key=lambda doc: doc[0])  # of like length together: tighter bounds
            for start in range(0, len(gathered), per_tree):
                tree = Tree(gathered[start : start + per_tree], width)
                for (_, ranks), heap in zip(items, heaps, strict=True):
                    tree.search(ranks, weight_of[ranks], heap, k)

        gathered = []
        for key, n, places, tfs in _read(batches):
            ranks = ranks_of[places]
            order = np.argsort(ranks)
            gathered.append((10 + (90 * n * n_docs) // n_terms, key, ranks[order], tfs[order]))
            if len(gathered) == GATHERED_DOCS:
                grow(gathered)
                gathered = []
        grow(gathered)
        out = [
            (item, None if key == _NULL else -key, score)
            for (item, _), heap in zip(items, heaps, strict=True)
            for score, key in heap
        ]
        columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc", "score"])

    return held.where(F.size("terms") > 0).mapInArrow(run, "item BIGINT, doc BIGINT, score BIGINT")
