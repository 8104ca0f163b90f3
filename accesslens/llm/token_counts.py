"""Token counts per section of a document, with the whole document encoded once.

Encoding sections one by one would give other tokens at their borders. Here the whole text is
encoded, the tokens' spans are laid against the sections' spans (a sorted interval join: two binary
searches per token), and a token that crosses a border is allocated by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: To which section a crossing token goes: that of its first byte, of its last, or the one that
#: holds most of its bytes (the earlier one of equals).
RULES = ("first", "last", "largest")


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    table = {base64.b64decode(token): int(rank) for token, rank in map(str.split, ranks.splitlines())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths


def allocate(starts: np.ndarray, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, does it cross a border). Sections begin at `starts`, the first at 0."""
    ends = np.cumsum(lengths)
    first = np.searchsorted(starts, ends - lengths, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = first != last
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    if rule == "largest":
        for i in np.flatnonzero(crossing):
            cuts = starts[first[i] + 1 : last[i] + 1]
            chosen[i] += int(np.argmax(np.diff([ends[i] - lengths[i], *cuts, ends[i]])))
    return chosen, crossing


def token_counts(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    border: str = r"\n",
    rule: str = "first",
) -> DataFrame:
    """One row per document and section: id, section, start, end, n_tokens, n_crossing.

    `ranks` is the text of a rank file, `pattern` its splitting pattern. A section ends behind each
    match of `border` and at the end of the text; offsets are code points, `end` is exclusive.
    `n_crossing` counts the tokens of the section that reach beyond it. The sections of a document
    hold all its tokens, each once. NULL or empty texts are one empty section; documents that
    repeat an identifier each have their own rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    cut = re.compile(border)

    @F.pandas_udf("array<struct<start:bigint,end:bigint,n_tokens:bigint,n_crossing:bigint>>")
    def counts_of(texts: pd.Series) -> pd.Series:
        encoding, lengths = _encoding(*shared.value)
        out = []
        for text in texts:
            text = text or ""
            borders = [m.end() for m in cut.finditer(text) if 0 < m.end() < len(text)]
            chars = np.unique(np.array([0, *borders], np.int64))
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            # Places of the bytes that begin a code point turn code points into bytes.
            heads = np.flatnonzero((raw & 0xC0) != 0x80) if len(chars) > 1 else np.zeros(1, np.int64)
            own = lengths[np.array(encoding.encode_ordinary(text), np.int64)]
            section, crossing = allocate(heads[chars] if len(raw) else chars, own, rule)
            tokens = np.bincount(section, minlength=len(chars))
            across = np.bincount(section[crossing], minlength=len(chars))
            ends = np.append(chars[1:], len(text))
            out.append(
                [
                    {"start": a, "end": b, "n_tokens": n, "n_crossing": c}
                    for a, b, n, c in zip(chars.tolist(), ends.tolist(), tokens.tolist(), across.tolist(), strict=True)
                ]
            )
        return pd.Series(out, dtype=object)

    counted = docs.select(F.col(id_col).alias("_id"), counts_of(F.col(text_col).cast("string")).alias("_sections"))
    return counted.select("_id", F.posexplode_outer("_sections").alias("section", "_s")).select(
        F.col("_id").alias(id_col), "section", "_s.start", "_s.end", "_s.n_tokens", "_s.n_crossing"
    )
