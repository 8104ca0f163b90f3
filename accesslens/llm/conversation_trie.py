"""The prefix trie of conversations, from vertical bitmaps (Zaki's vertical layout, as in SPAM by Ayres and others, 2002).

Turns become keys (a digest of role and text) before anything is moved. Conversations are dealt by
ranges of their ids into shards of bounded size. A shard's index has one bitset over its
conversations for each (position, turn); going depth first, a node's bitset intersected with the
postings of the next position gives its children, the popcounts how many conversations pass, and
the members without a next turn the list of those that end. A node is known in all shards by a
digest of its path, so that shards are merged by key.

What a node's subtree sums up is additive over shards, once it is known which conversation is the
smallest of each node (its owner): a node is counted in the shard of its owner alone. So a second,
streaming pass over each shard's nodes in reverse order of the first one sums children, leaves and
saved bytes, and the shards' sums are added up per node. Lists of ends are hashed as a stream of the
shards' parts, in the order of the ids. No task holds more than a shard of `SHARD_TURNS` turns:
a longer conversation is a shard by itself and passes as a stream.

NULL ids are no conversations. Turns of a conversation are ordered by turn (NULL first), then role
and text; repeated rows are repeated turns. NULL roles and texts are empty. An empty table has no
nodes. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Conversations and turns of a shard at most; a bitset has one bit for each conversation.
SHARD_CONVERSATIONS = 1024
SHARD_TURNS = 1 << 16
_ROWS = 4096

_ROOT = hashlib.sha256(b"").digest()
_NODES = (
    "shard BIGINT, at BIGINT, node BINARY, parent BINARY, depth BIGINT, n_bytes BIGINT, n_convs BIGINT, "
    "first BIGINT, has_children BOOLEAN, ends STRING"
)


def turns(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, position from 0, turn BINARY, n_bytes, n_turns) per turn: what the trie is made of."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The role's length parts it from the text.
    key = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role), F.concat(role, text)), 256))
    rows = conversations.select(
        F.col(id_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("place"),
        role.alias("role"),
        F.sha2(text, 256).alias("text_key"),
        key.alias("turn"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).where("conv IS NOT NULL")
    # Ties of place and role: by digest of the text, which does not move the text itself.
    order = Window.partitionBy("conv").orderBy(F.col("place").asc_nulls_first(), "role", "text_key")
    whole = Window.partitionBy("conv")
    return rows.select(
        "conv",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        "turn",
        "n_bytes",
        F.count(F.lit(1)).over(whole).alias("n_turns"),
    )


def path_key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(parent + turn).digest()


class _Rows:
    """Node rows on their way out, in batches."""

    def __init__(self, schema: pa.Schema):
        self._schema, self._rows = schema, []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self._rows.append(row)
        if len(self._rows) == _ROWS:
            yield self.rest()

    def rest(self) -> pa.RecordBatch:
        columns = list(zip(*self._rows, strict=True)) or [()] * len(self._schema)
        self._rows = []
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns, self._schema.types)), schema=self._schema)


_NODE_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("at", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()),
    ("n_bytes", pa.int64()), ("n_convs", pa.int64()), ("first", pa.int64()), ("has_children", pa.bool_()),
    ("ends", pa.string()),
])


def bits(bitset: int) -> Iterator[int]:
    """The places of the set bits, ascending."""
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def shard_nodes(members: list[tuple[int, list[tuple[bytes, int]]]]) -> Iterator[tuple]:
    """Node rows of a shard, depth first: members are (conv, [(turn, n_bytes)]) by ascending conv."""
    postings: dict[tuple[int, bytes], int] = {}
    going_on: dict[int, int] = {}  # position -> conversations that have a turn there
    for i, (_, path) in enumerate(members):
        for position, (turn, _) in enumerate(path):
            postings[position, turn] = postings.get((position, turn), 0) | 1 << i
            going_on[position] = going_on.get(position, 0) | 1 << i
    shard, at = members[0][0], 0
    todo = [((1 << len(members)) - 1, 0, _ROOT, None, 0)]
    while todo:
        here, depth, node, parent, n_bytes = todo.pop()
        left = here & going_on.get(depth, 0)
        ending = here & ~left
        ends = ",".join(str(members[i][0]) for i in bits(ending)) if ending else None
        first = members[(here & -here).bit_length() - 1][0]
        yield shard, at, node, parent, depth, n_bytes, here.bit_count(), first, left != 0, ends
        at += 1
        while left:
            turn, size = members[(left & -left).bit_length() - 1][1][depth]
            child = left & postings[depth, turn]
            todo.append((child, depth + 1, path_key(node, turn), node, size))
            left &= ~child


def long_nodes(conv: int, path: Iterator[tuple[bytes, int]], n_turns: int) -> Iterator[tuple]:
    """The same for one conversation, whose turns are not held."""
    node, parent, size = _ROOT, None, 0
    for depth in range(n_turns):
        yield conv, depth, node, parent, depth, size, 1, conv, True, None
        turn, size = next(path)
        node, parent = path_key(node, turn), node
    yield conv, n_turns, node, parent, n_turns, size, 1, conv, False, str(conv)


def _local_nodes(batches, most_turns: int, most_convs: int) -> Iterator[pa.RecordBatch]:
    """Node rows of the shards that a partition, sorted by (conv, position), is cut into."""
    out = _Rows(_NODE_SCHEMA)

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def emit(nodes):
        for row in nodes:
            yield from out.add(row)

    members, held = [], 0
    for conv, group in groupby(rows(), key=itemgetter(0)):
        row = next(group)
        n_turns = row[4]
        if members and (held + n_turns > most_turns or len(members) == most_convs):
            yield from emit(shard_nodes(members))
            members, held = [], 0
        if n_turns > most_turns:
            yield from emit(long_nodes(conv, _after(row, group), n_turns))
            continue
        path = list(_after(row, group)) if n_turns else []
        members.append((conv, path))
        held += n_turns
    if members:
        yield from emit(shard_nodes(members))
    yield out.rest()


def _after(row, group) -> Iterator[tuple[bytes, int]]:
    yield row[2], row[3]
    for other in group:
        yield other[2], other[3]


def _subtree_sums(batches) -> Iterator[pa.RecordBatch]:
    """(node, parent's owner, children, leaves, saved bytes) per shard, from its nodes in reverse order.

    Children come before their parent. What waits for a parent is one list of its children a depth:
    their members differ, so there are never more of them than conversations in the shard.
    """
    out = _Rows(pa.schema([
        ("node", pa.binary()), ("parent_conv_id", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved", pa.int64()),
    ]))
    waiting: dict[int, list] = {}
    for batch in batches:
        for node, depth, n_bytes, n_convs, owner, owned, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            children = waiting.pop(depth + 1, ())
            n_children, n_leaves, saved = 0, int(owned and leaf), (n_convs - owned) * n_bytes
            for child, child_owned, sums in children:
                n_children += child_owned
                n_leaves += sums[1]
                saved += sums[2]
                yield from out.add((child, owner, *sums))
            if depth:
                waiting.setdefault(depth, []).append((node, owned, (n_children, n_leaves, saved)))
            else:
                yield from out.add((node, None, n_children, n_leaves, saved))
    yield out.rest()


def _hashed_ends(batches) -> Iterator[pa.RecordBatch]:
    """(node, digest) from parts of the lists of ends, sorted by (node, first id)."""
    out = _Rows(pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))
    current, digest = None, None
    for batch in batches:
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != current:
                if current is not None:
                    yield from out.add((current, digest.hexdigest()))
                current, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
    if current is not None:
        yield from out.add((current, digest.hexdigest()))
    yield out.rest()


def prefix_trie(
    turn_rows: DataFrame, most_turns: int = SHARD_TURNS, most_convs: int = SHARD_CONVERSATIONS
) -> DataFrame:
    """Nodes of the trie of conversations given as rows of `turns`; those without a turn as one row
    whose n_turns is 0.

    Per node: node and parent (BINARY path digests), depth, conv_id (its smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_bytes (over the subtree, the bytes of each
    node's last text times its members but one) and ends_sha256 (of the ids that end there,
    ascending, joined by commas).
    """
    spark = turn_rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        turn_rows.select("conv", "position", "turn", "n_bytes", "n_turns")
        .repartitionByRange(width, "conv")
        .sortWithinPartitions("conv", "position")
    )
    local = settle(dealt.mapInArrow(lambda batches: _local_nodes(batches, most_turns, most_convs), _NODES), "trie-nodes")

    same = Window.partitionBy("node")
    known = local.drop("ends").select(
        "*",
        F.min("first").over(same).alias("owner"),
        (~F.max("has_children").over(same)).alias("leaf"),
    )
    reverse = (
        known.repartition(width, "shard")
        .sortWithinPartitions("shard", F.desc("at"))
        .select("node", "depth", "n_bytes", "n_convs", "owner", (F.col("owner") == F.col("first")).alias("owned"), "leaf")
    )
    sums = reverse.mapInArrow(
        _subtree_sums, "node BINARY, parent_conv_id BIGINT, n_children BIGINT, n_leaves BIGINT, saved BIGINT"
    )
    whole = sums.groupBy("node").agg(
        F.max("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves")),
        F.sum("saved").alias("saved_bytes"),
    )
    shape = local.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("first").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
    )
    ends = (
        local.where("ends IS NOT NULL")
        .select("node", "ends", "shard")
        .repartition(width, "node")
        .sortWithinPartitions("node", "shard")
        .mapInArrow(_hashed_ends, "node BINARY, ends_sha256 STRING")
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        shape.join(whole, "node")
        .join(ends, "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they stand; `columns` as in `turns`."""
    return prefix_trie(turns(conversations, **columns))


def branched(turn_rows: DataFrame) -> DataFrame:
    """Conversations that begin like their neighbour: rows of `turns`, and one for each without a turn.

    Conversation c takes the first h turns of conversation c - c % 5 (as many as there are), then its
    own from its h-th on, h = crc32(c in decimals) % 9.
    """
    base = F.col("conv") - F.col("conv") % 5
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    lengths = turn_rows.where("position = 0").select("conv", "n_turns", base.alias("base"), taken.alias("taken"))
    lengths = settle(lengths, "conversations")
    bases = lengths.select(F.col("conv").alias("base"), F.col("n_turns").alias("base_turns"))
    plan = lengths.join(bases, "base", "left").select(
        "conv", "base", "taken", F.least("taken", F.coalesce("base_turns", F.lit(0))).alias("borrowed"),
        F.greatest(F.col("n_turns") - F.col("taken"), F.lit(0)).alias("own"),
    )
    plan = settle(plan.withColumn("n_turns", F.col("borrowed") + F.col("own")), "branches")

    rows = turn_rows.drop("n_turns")
    # At most the first 8 turns of a conversation are lent, to the 4 (around 0, 8) others that have it as base.
    lent = rows.where("position < 8").withColumnRenamed("conv", "base")
    borrowed = plan.join(lent, "base").where("position < borrowed").select("conv", "position", "turn", "n_bytes", "n_turns")
    own = (
        rows.join(plan, "conv")
        .where("position >= taken")
        .select("conv", (F.col("position") - F.col("taken") + F.col("borrowed")).alias("position"), "turn", "n_bytes", "n_turns")
    )
    empty = plan.where("n_turns = 0").select(
        "conv", F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("binary").alias("turn"),
        F.lit(None).cast("bigint").alias("n_bytes"), "n_turns",
    )
    return borrowed.unionByName(own).unionByName(empty)
