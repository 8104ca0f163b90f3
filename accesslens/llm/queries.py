"""The text operators as named queries, each over its whole table, with a check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_lexicon import build_lexicon, encode, frequent_words, read_vocabulary
from .common import table
from .conversation_trie import branched, prefix_trie, turns
from .decontamination import find_items
from .exact_dedup import exact_duplicates
from .hidden_markov import score_texts
from .language_id import identify, learn
from .line_dedup import drop_boilerplate_lines
from .mil_quality import held_out, score, train
from .pii_crf import KINDS, find_personal_data
from .pii_crf import train as train_field
from .ranked_search import search
from .site_templates import extract_text
from .sketch_dedup import near_duplicates
from .token_counts import token_counts

#: A sentence ends behind the white space after its sign, or behind a line feed.
SENTENCE_END = r"[.!?]\s+|\n"


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Tokens per sentence of every document. Sentences end behind `SENTENCE_END`, inside the token that
    begins with the space there; it goes to the sentence with most of its bytes."""
    ranks = read_vocabulary(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, ranks, public_tokenizers.PATTERN, border=SENTENCE_END, rule="largest")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "text", "n_lines", "n_dropped")


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train_field(docs))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(spans, kind):
        return F.filter(spans, lambda s: s["kind"] == kind)

    # All spans in the same order: kinds as listed, then start.
    every = F.concat(*(F.array_sort(of_kind(F.concat("base", "added"), kind)) for kind in KINDS))
    return found.select(
        "doc_id",
        *(F.size(of_kind("base", kind)).cast("bigint").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(every).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encoded_digests(docs.select("doc_id", "text"), vocabulary_path).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def encoded_digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """`docs` encoded and decoded: digests of ids and decoded text instead of `text`, ids and texts themselves."""
    vocabulary = read_vocabulary(vocabulary_path or public_tokenizers.path("word_bpe_49k.json"))
    lexicon = build_lexicon(frequent_words(docs, "text", vocabulary), vocabulary)
    kept = [c for c in docs.columns if c != "text"]
    # In one Python worker a task, and without the text on the way back: half the memory of two maps.
    both = encode(docs, vocabulary, lexicon, decoded_col="decoded", keep_text=False)
    return both.select(
        *kept,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    unseen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), learn(docs.where(~unseen)))
    return found.select("doc_id", unseen.alias("held_out"), "lang_pred", "score")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin as others do; see `branched` for how they are rebuilt."""
    trie = prefix_trie(branched(turns(table(spark, sf_dir, "conversations"))))
    return trie.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), "ends_sha256",
    )


_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = f"list_filter(regexp_split_to_array({_SQL_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _sql_shingles(source: str, id_col: str) -> str:
    """(id, shingle) rows, distinct; fewer words than five are one shingle."""
    return f"""(SELECT DISTINCT {id_col}, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
      FROM (SELECT {id_col}, {_SQL_WORDS} AS w FROM {source}))"""


def _sql_crc32(id_col: str) -> str:
    """The CRC-32 of an integer's decimals, bit by bit (reflected polynomial 0xEDB88320)."""
    return f"""xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split({id_col}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
          lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""


SQL = {
    "op3_line_dedup": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
pages AS (SELECT DISTINCT host, text FROM docs),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_transform(string_split(text, chr(10)),
      lambda l: trim(l, concat(' ', chr(9), chr(13)))))) AS line FROM pages)
  WHERE line <> '' GROUP BY host, line HAVING count(*) >= 5),
bad AS (
  SELECT host, list(line) AS lines FROM counts JOIN totals USING (host)
  WHERE n / total > 0.05 GROUP BY host),
split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l, coalesce(lines, []) AS lines
  FROM docs LEFT JOIN bad USING (host)),
kept AS (
  SELECT doc_id, l, list_filter(l, lambda x: NOT list_contains(lines, trim(x, concat(' ', chr(9), chr(13))))) AS k FROM split)
SELECT doc_id, array_to_string(k, chr(10)) AS text, len(l)::BIGINT AS n_lines,
  (len(l) - len(k))::BIGINT AS n_dropped FROM kept
""",
    "op7_decontamination": f"""
WITH items AS {_sql_shingles('benchmark', 'item_id')},
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
docs AS {_sql_shingles('documents', 'doc_id')},
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared / n_item AS containment
FROM hits JOIN sizes USING (item_id) WHERE n_shared / n_item >= 0.8
""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_SQL_LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
""",
    "op11_document_tree": r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
docs AS (SELECT doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM docs),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tfs AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, total GROUP BY term),
scored AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l))))::BIGINT AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""",
    "op12_rank_order_profiles": rf"""
WITH docs AS (
  SELECT doc_id, text, lang, coalesce({_sql_crc32('doc_id')} % 4 = 2, false) AS held_out FROM documents),
words AS (
  SELECT doc_id, held_out, lang, word, count(*) AS n FROM (
    SELECT doc_id, held_out, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM docs) GROUP BY ALL),
grams AS (
  SELECT doc_id, held_out, lang, gram, sum(n)::BIGINT AS n FROM (
    SELECT doc_id, held_out, lang, n, unnest(
      string_split(word, '')
      || list_transform(range(1, length(word) + 2), lambda i: substr(concat(' ', word, ' '), i, 2))
      || list_transform(range(1, length(word) + 1), lambda i: substr(concat(' ', word, ' '), i, 3))) AS gram FROM words)
  GROUP BY ALL),
profiles AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) AS r
  FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY r <= 400),
own AS (
  SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) AS r
  FROM grams QUALIFY r <= 400),
apart AS (
  SELECT doc_id, l.lang, sum(coalesce(least(abs(p.r - own.r), 400), 400)) AS distance, count(*) AS size
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l
  LEFT JOIN profiles p ON p.gram = own.gram AND p.lang = l.lang GROUP BY ALL),
best AS (
  SELECT doc_id, lang, 1.0::DOUBLE - distance::DOUBLE / (400 * size)::DOUBLE AS score FROM apart
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0::DOUBLE) AS score
FROM docs LEFT JOIN best USING (doc_id)
""",
    "op13_conversation_trie": rf"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS p,
    concat(strlen(role), ':', role, text) AS t, strlen(text) AS b
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {_sql_crc32('conv_id')} % 9 AS h FROM own GROUP BY conv_id),
plan AS (SELECT i.*, least(i.h, coalesce(o.n, 0)) AS lent FROM ids i LEFT JOIN ids o ON o.conv_id = i.base),
rebuilt AS (
  SELECT plan.conv_id, p, t, b FROM plan JOIN own ON own.conv_id = plan.base WHERE p < lent
  UNION ALL SELECT plan.conv_id, p - h + lent, t, b FROM plan JOIN own USING (conv_id) WHERE p >= h),
paths AS (
  SELECT conv_id, list(sha256(t) ORDER BY p) AS path, list(b ORDER BY p) AS sizes FROM rebuilt GROUP BY conv_id),
convs AS (SELECT conv_id, coalesce(path, []) AS path, sizes FROM ids LEFT JOIN paths USING (conv_id)),
members AS (
  SELECT conv_id, len(path) AS turns, d, array_to_string(path[1:d], ',') AS node,
    CASE WHEN d > 0 THEN array_to_string(path[1:d-1], ',') END AS parent, coalesce(sizes[d], 0) AS b
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM convs)),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256
  FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT DISTINCT x.node, y.node AS under FROM members x JOIN members y ON x.conv_id = y.conv_id AND y.d >= x.d),
sums AS (
  SELECT below.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens
  FROM below JOIN nodes ON nodes.node = under LEFT JOIN children ON children.node = under GROUP BY below.node)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON sums.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes up ON up.node = n.parent
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_site_templates": op4_site_templates,
    "op5_pii_crf": op5_pii_crf,
    "op6_bpe_lexicon": op6_bpe_lexicon,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_mil_quality": op10_mil_quality,
    "op11_document_tree": op11_document_tree,
    "op12_rank_order_profiles": op12_rank_order_profiles,
    "op13_conversation_trie": op13_conversation_trie,
}
