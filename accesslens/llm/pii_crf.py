"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. The field then labels the tokens that hold a digit or an '@'
(every other token is O by construction, which cuts the chain into short segments) with O or a
kind. Neighbouring tokens of digits and signs make a form (a number typed in groups). Potentials:

- node: log odds of the label given the token's shape, and given its neighbours on either side;
  tokens inside base spans are observed;
- chain: neighbouring tokens of a segment, but across the border of a base span, which the pattern
  has settled, or between a token that is linked and one that is not;
- skip: a form and the previous one in the document that ends in the same seven digits, token by
  token along the digits they share; a token and the previous one with the same four numbers, or
  with the same local part before an '@'. However far away and differently typed, forms of one
  entity so share their evidence. A form has one predecessor for each key: links grow with the tokens.

Potentials are trained piecewise from counts over all documents, aggregated in Spark: each factor's
own log odds, the base spans being the labels. A token outside every base span that is linked to
one inside has no known label: it is what the field is to tell, and teaches nothing. So the skip
factor learns, from entities met by the patterns more than once, how far one form tells another.
Loopy belief propagation passes messages along chain and skip edges, damped, a fixed number of
rounds. Tokens labelled with a kind outside every base span are added, joined where neighbours agree.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1  # 0 is O
_BUCKETS = 4096
ROUNDS = 12
#: Added spans need this posterior probability.
CERTAIN = 0.9
#: Digits at their ends that two forms of one number share.
TAIL = 7
#: Log odds against any label but its own for a token inside a base span.
OBSERVED = 20.0
#: Edges whose messages are computed at a time, to bound memory on very long texts.
EDGE_BLOCK = 100_000

# The base patterns, with runs that a match cannot give back made possessive.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    # From each '@' back to where its run of local characters begins: linear, whatever the text.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            done = at + 1  # no later match can begin before this '@'
            at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(match[0])) <= 15:
                found.append((3, match.start(), match.end()))
    return found


def _hash(*parts) -> int:
    return zlib.crc32(repr(parts).encode("utf-8", "backslashreplace")) % _BUCKETS


_RUNS = (re.compile(r"[0-9]++"), re.compile(r"[^\W\d_]++"))


def _shape(token: str) -> str:
    """Digits as 9 (a run of over four as 99), letters as a; signs as they are."""
    token = _RUNS[0].sub(lambda m: "9" * len(m[0]) if len(m[0]) <= 4 else "99", token)
    return _RUNS[1].sub("a", token)


_PLAIN = re.compile(r"[0-9+().,;:!?/-]++\Z")
_FOUR = re.compile(r"(?<![0-9])([0-9]{1,3})[._-]([0-9]{1,3})[._-]([0-9]{1,3})[._-]([0-9]{1,3})(?![0-9])")


def _keys(token: str) -> list[tuple]:
    """What other forms of a token's entity have in common with it, besides a number's last digits."""
    local, sign, _ = token.partition("@")
    if sign:
        return [("local", local.lower())] if len(local) >= 3 else []
    four = _FOUR.search(token)
    return [("four", *map(int, four.groups()))] if four and all(map(_small, four.groups())) else []


def _shared_end(one: str, other: str) -> int:
    """How many characters two strings share at their ends."""
    n = min(len(one), len(other))
    if n == 0 or one[-n:] == other[-n:]:
        return n
    low, high = 0, n - 1  # the longest shared end has between low and high characters
    while low < high:
        middle = (low + high + 1) // 2
        if one[-middle:] == other[-middle:]:
            low = middle
        else:
            high = middle - 1
    return low


def _cover(places: list[tuple[int, int]], other: list[tuple[int, int]], shared: int) -> list[tuple[int, int]]:
    """Tokens of a form, each with the other form's token that holds its last digit, over the digits
    that both share. Forms are (digits behind the token, token) from the last token on."""
    pairs, at = [], 0
    for behind, token in places:
        if behind >= shared:
            break
        while at + 1 < len(other) and other[at + 1][0] <= behind:
            at += 1
        pairs.append((token, other[at][1]))
    return pairs


class Graph:
    """The tokens of one document that may be personal data, their features, labels and edges."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        n = len(self.tokens)
        self.labels = np.zeros(n, np.int64)
        order = sorted((s, e, kind) for kind, s, e in spans)
        inside = [-1] * n
        at = 0
        for i, (start, end) in enumerate(self.tokens):
            while at < len(order) and order[at][1] <= start:
                at += 1
            if at < len(order) and order[at][0] < end:
                self.labels[i] = order[at][2] + 1
                inside[i] = at
        words = [text[s:e] for s, e in self.tokens]
        joined = [
            i > 0 and self.tokens[i][0] - self.tokens[i - 1][1] <= 2
            and text[self.tokens[i - 1][1] : self.tokens[i][0]].isspace()
            for i in range(n)
        ]
        shapes = [_shape(word) for word in words]
        self.features = []
        for i in range(n):
            left = shapes[i - 1] if joined[i] else ""
            right = shapes[i + 1] if i + 1 < n and joined[i + 1] else ""
            self.features.append((_hash("own", shapes[i]), _hash("left", left, shapes[i][:4]), _hash("right", right, shapes[i][:4])))

        self.skip = self._links(words, joined, inside)
        linked = np.zeros(n, bool)
        told = self.labels > 0
        near = defaultdict(list)
        for i, j in self.skip:
            linked[[i, j]] = True
            near[i].append(j)
            near[j].append(i)
        # Along links from what is labelled: the labels of everything else there are not known.
        ahead = [i for i in near if told[i]]
        while ahead:
            for j in near[ahead.pop()]:
                if not told[j]:
                    told[j] = True
                    ahead.append(j)
        self.known = ~told | (self.labels > 0)
        self.chain = [
            (i - 1, i) for i in range(1, n)
            if joined[i] and inside[i] == inside[i - 1] and (inside[i] >= 0 or linked[i] == linked[i - 1])
        ]

    def _links(self, words: list[str], joined: list[bool], inside: list[int]) -> list[tuple[int, int]]:
        links: list[tuple[int, int]] = []
        before: dict[tuple, int] = {}
        for i, word in enumerate(words):
            for key in _keys(word):
                if key in before:
                    links.append((before[key], i))
                before[key] = i

        digits = ["".join(_DIGITS.findall(word)) if "@" not in word else "" for word in words]
        plain = [bool(_PLAIN.match(word)) for word in words]
        ends: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        i = 0
        while i < len(words):
            j = i + 1
            while (j < len(words) and joined[j] and plain[j] and plain[j - 1] and inside[j] == inside[j - 1]
                   and words[j][0] != "+" and words[j - 1][-1] not in ",;:!?"):
                j += 1
            number = "".join(digits[i:j])
            if len(number) >= TAIL:
                # Tokens from the last one on, each with the number of digits behind it.
                places, behind = [], 0
                for token in range(j - 1, i - 1, -1):
                    places.append((behind, token))
                    behind += len(digits[token])
                other, their = ends.get(number[-TAIL:], ("", []))
                shared = _shared_end(number, other)
                links += [(j, i) for i, j in _cover(places, their, shared)]
                links += _cover(their, places, shared)
                ends[number[-TAIL:]] = number, places
            i = j
        return sorted(set(links))


def _posteriors(graph: Graph, model: dict[str, np.ndarray]) -> np.ndarray:
    """Marginals by damped loopy belief propagation over all edges at once."""
    node = model["node"][np.array(graph.features)].sum(axis=1) + model["prior"]
    observed = np.flatnonzero(graph.labels)
    node[observed] = -OBSERVED
    node[observed, graph.labels[observed]] = 0.0
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    if not len(edges):
        beliefs = node
    else:
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        factors = np.stack([model["chain"], model["skip"], model["chain"].T, model["skip"].T])
        kind = (np.arange(len(edges)) >= len(graph.chain)).astype(np.int64)
        kind = np.concatenate([kind, kind + 2])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), _LABELS))
        for _ in range(ROUNDS):
            beliefs = node.copy()
            np.add.at(beliefs, target, messages)
            fresh = np.empty_like(messages)
            for at in range(0, len(source), EDGE_BLOCK):
                part = slice(at, at + EDGE_BLOCK)
                into = (beliefs[source[part]] - messages[back[part]])[:, :, None] + factors[kind[part]]
                top = into.max(axis=1)
                told = top + np.log(np.exp(into - top[:, None, :]).sum(axis=1))
                fresh[part] = told - told.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * fresh
        beliefs = node.copy()
        np.add.at(beliefs, target, messages)
    raised = np.exp(beliefs - beliefs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], model: dict[str, np.ndarray] | None) -> list[tuple[int, int, int]]:
    """Spans the field adds to the base ones, none of them overlapping a base span."""
    graph = Graph(text, spans) if model is not None else None
    if graph is None or not graph.tokens:
        return []
    marginals = _posteriors(graph, model)
    best = marginals.argmax(axis=1)
    take = (best > 0) & (marginals.max(axis=1) >= CERTAIN) & (graph.labels == 0)
    joined = {j for _, j in graph.chain}
    out: list[list[int]] = []
    last = -2
    for i in np.flatnonzero(take).tolist():
        start, end = graph.tokens[i]
        kind = int(best[i]) - 1
        if i == last + 1 and i in joined and out[-1][0] == kind:
            out[-1][2] = end
        else:
            out.append([kind, start, end])
        last = i
    return [tuple(span) for span in out]


# Factors counted in training: 0 prior, 1 node (bucket), 2 chain, 3 skip; with the labels involved.
_COUNTS = "factor INT, at INT, label INT, n BIGINT"


def factor_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """How often each factor went with each label, over all documents; a bounded number of rows."""

    def run(batches):
        counts: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for text in batch["text"]:
                graph = Graph(text or "", base_spans(text or ""))
                labels, known = graph.labels.tolist(), graph.known.tolist()
                for i, features in enumerate(graph.features):
                    if known[i]:
                        counts[0, 0, labels[i]] += 1
                        for feature in features:
                            counts[1, feature, labels[i]] += 1
                for i, j in graph.chain:
                    if known[i] and known[j]:
                        counts[2, labels[i], labels[j]] += 1
                for i, j in graph.skip:
                    if known[i] and known[j]:  # alike both ways round
                        counts[3, labels[i], labels[j]] += 1
                        counts[3, labels[j], labels[i]] += 1
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["factor", "at", "label", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(run, _COUNTS).groupBy("factor", "at", "label").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """Potentials from smoothed counts: at most 4,096 buckets by five labels reach the driver."""
    tables = [np.zeros((1, _LABELS)), np.zeros((_BUCKETS, _LABELS)), np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS))]
    for factor, at, label, n in factor_counts(docs, text_col).collect():
        tables[factor][at, label] += n
    prior = (tables[0][0] + 1) / (tables[0].sum() + _LABELS)

    def lift(counts: np.ndarray) -> np.ndarray:
        """log P(label | factor) / P(label), drawn to 0 where a factor was rarely seen."""
        given = (counts + 4 * prior) / (counts.sum(axis=1, keepdims=True) + 4)
        return np.log(given / prior)

    # Three features tell partly the same, so that each counts for a third of its weight.
    return {"prior": np.log(prior), "node": lift(tables[1]) / 3, "chain": lift(tables[2]), "skip": lift(tables[3])}


def find_personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None, text_col: str = "text") -> DataFrame:
    """`docs` with `base` and `added`: arrays of (kind, start, end), in code points, end exclusive.

    Both are ordered by kind as in KINDS, then start. NULL counts as empty; texts without a digit or
    an '@' have no spans. Every row is judged by its own whole text. Without a model nothing is added.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, added {span}")
    def spans_of(texts: pd.Series) -> pd.DataFrame:
        base, added = [], []
        for text in texts:
            own = base_spans(text or "")
            base.append(_named(own))
            added.append(_named(added_spans(text or "", own, shared.value)))
        return pd.DataFrame({"base": base, "added": added})

    return docs.withColumn("_spans", spans_of(F.col(text_col).cast("string"))).select(
        *docs.columns, "_spans.base", "_spans.added"
    )


def _named(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[kind], "start": start, "end": end} for kind, start, end in sorted(spans)]
