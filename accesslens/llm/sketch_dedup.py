"""Near duplicates: fast similarity sketches, banding, exact verification on whole shingle sets.

The sketch is Fast Similarity Sketching (Dahlgaard, Knudsen, Thorup, 2017): in round i every
element is placed in a hashed bin with a hashed value, rounds after the first `t` place all
elements in one bin each, so after 2t rounds every coordinate is filled, and the number of equal
coordinates is concentrated around the Jaccard similarity as with `t` independent minima. Work is
O(t log t + set size) per document instead of O(t * set size).

1. Documents with the same shingle set are one class; only classes go on.
2. Classes that agree in a whole band share a bucket. A bucket never emits its pairs: each member
   is paired with the bucket's smallest class, and verified links are merged to components.
3. Buckets that still hold several components are looked at again, with another leader in each,
   then once more for every pair of members of different components. Members that are linked
   already, the bulk of a large group of copies, take no part; no pair is left out but those of
   one component, pairs whose set sizes or numbers of shingles found nowhere else rule the
   similarity out, and pairs with so few equal coordinates that a similarity of 0.8 has odds below
   one in a million. What is left after the first look is told apart by a second sketch of 1,024
   coordinates, one bit each, and a pair is made in the first of the buckets it shares only.
4. Every link is confirmed by intersecting the two full sets.

With 24 bands of 4 rows, a pair at similarity 0.8 shares no band with odds of 3e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import settle
from .components import components

BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Equal coordinates (of 96) below which a pair at the threshold is ruled out: odds of 5e-7.
FEWEST_EQUAL = 53
_TAGS = COORDINATES // 8  # longs that hold one byte per coordinate

#: The second sketch, one bit per coordinate: a pair of similarity s agrees in (1 + s) / 2 of them.
FINE = 1024
#: Equal bits (of 1,024) below which a pair at the threshold is ruled out: odds of 5e-7.
FEWEST_FINE = 872

_U = np.uint64
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = mix(np.arange(1, 2 * FINE + 1, dtype=_U) * _WEIGHTS[0])


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none are none."""
    # bytes.lower() changes A-Z only and bytes.split() parts at \\x20 and \\x09-\\x0D.
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, _U)
    hashes = np.fromiter(map(xxh3_64_intdigest, parts), _U, len(parts))
    width = min(k, len(parts))
    shingles = np.full(len(parts) - width + 1, width, _U)
    for j in range(width):
        shingles = mix(shingles * _WEIGHTS[1] + hashes[j : len(hashes) - width + 1 + j])
    return np.unique(shingles)


def set_digest(elements: np.ndarray) -> bytes:
    """128 bits that tell shingle sets apart."""
    with np.errstate(over="ignore"):
        sums = [int(mix(elements ^ w).sum(dtype=_U)) for w in _WEIGHTS[:2]]
    return b"".join(s.to_bytes(8, "little") for s in sums)


def _key() -> Column:
    """A long in place of the digest: with the class' identifier it names the class."""
    return F.xxhash64("digest").alias("key")


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """`t` coordinates of a non-empty set. Rounds run in blocks; the first to fill a bin wins it."""
    filled = np.zeros(t, bool)
    out = np.zeros(t, _U)
    at, block = 0, max(1, 6 * t // len(elements))
    while not filled.all():
        rounds = np.arange(at, min(at + block, 2 * t))
        h = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        value = h & _U(0xFFFFFFFF)
        bins = ((h >> _U(32)) * _U(t)) >> _U(32)
        fixed = rounds >= t
        if fixed.any():
            bins[fixed] = (rounds[fixed] - t).astype(_U)[:, None]
        order = (bins << _U(48)) | ((rounds - at).astype(_U)[:, None] << _U(32)) | value
        order = np.sort(order, axis=None)
        bin_of = (order >> _U(48)).astype(np.int64)
        first = np.flatnonzero(np.diff(bin_of, prepend=-1))
        first = first[~filled[bin_of[first]]]
        hit = bin_of[first]
        out[hit] = (order[first] & _U(0xFFFFFFFFFFFF)) + (_U(at) << _U(32))
        filled[hit] = True
        at = int(rounds[-1]) + 1
    return mix(out)


_SCHEMA = pa.schema(
    [
        ("n", pa.int64()),
        ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("tags", pa.list_(pa.int64())),
    ]
)
_DDL = "n BIGINT, digest BINARY, bands ARRAY<BIGINT>, tags ARRAY<BIGINT>"


def _sketch_batches(k: int, id_field: pa.Field):
    schema = pa.schema([id_field.with_name("id"), *_SCHEMA])

    def run(batches):
        for batch in batches:
            n, digests, sketches, at = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                elements = shingle_set(text, k)
                n.append(len(elements))
                digests.append(set_digest(elements))
                if len(elements):
                    sketches.append(sketch(elements))
                    at.append(i)
            bands, tags = [None] * len(n), [None] * len(n)
            if at:
                coordinates = np.stack(sketches)
                keys = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(at), BANDS)).copy()
                for row in range(ROWS):
                    keys = mix(keys * _WEIGHTS[2] + coordinates[:, row::ROWS])
                low = (coordinates & _U(255)).astype(np.uint8).view(np.int64)
                for i, key, tag in zip(at, keys.view(np.int64).tolist(), low.tolist(), strict=True):
                    bands[i], tags[i] = key, tag
            columns = [pa.array(c, f.type) for c, f in zip((n, digests, bands, tags), _SCHEMA, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return run


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _may_share(n_a: Column, own_a: Column, n_b: Column, own_b: Column, percent: int) -> Column:
    """An upper bound of the similarity: shingles that only one of all candidates has are not shared."""
    most = F.least(n_a - own_a, n_b - own_b)
    return most * 100 >= (n_a + n_b - most) * percent


def _candidate_texts(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    ids = candidates.select(F.col("rep").alias("id")).distinct()
    return texts.join(ids, "id", "left_semi").select("id", "text")


def _own_shingles(texts: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(rep, key, own): how many shingles of each candidate no other candidate has."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, k) for text in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64))
            )
            digests = pa.array(map(set_digest, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, lists], names=["rep", "digest", "shingles"])

    kind = dict(candidates.dtypes)["rep"]
    sets = _candidate_texts(texts, candidates).mapInArrow(run, f"rep {kind}, digest BINARY, shingles ARRAY<BIGINT>")
    once = (
        sets.select("rep", _key(), F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(
            F.min("rep").alias("rep"), F.max("rep").alias("last"),
            F.min("key").alias("key"), F.max("key").alias("last_key"),
        )
        .where("rep = last AND key = last_key")
    )
    return once.groupBy("rep", "key").agg(F.count(F.lit(1)).alias("own"))


def _fine_sketches(texts: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(rep, key, fine): the second sketch of each candidate, 64 coordinates a long."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, k) for text in batch.column(1).to_pylist()]
            fine = [
                np.packbits((sketch(one, FINE) & _U(1)).astype(bool)).view(np.int64) if len(one) else None
                for one in sets
            ]
            columns = [pa.array(map(set_digest, sets), pa.binary()), pa.array(fine, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["rep", "digest", "fine"])

    kind = dict(candidates.dtypes)["rep"]
    made = _candidate_texts(texts, candidates).mapInArrow(run, f"rep {kind}, digest BINARY, fine ARRAY<BIGINT>")
    return made.groupBy("rep", _key()).agg(F.first("fine").alias("fine"))


def _fine_enough(a: Column, b: Column) -> Column:
    """Whether the second sketches allow the similarity; those not made yet allow all."""
    differing = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for i in range(1, FINE // 64):
        differing = differing + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return F.coalesce(differing <= FINE - FEWEST_FINE, F.lit(True))


def _equal_tags(a: Column, b: Column) -> Column:
    """Coordinates with equal tags: per byte of the difference, its lowest bit gathers all eight."""
    ones = F.lit(0x0101010101010101).cast("bigint")

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(ones))

    total = differing(0)
    for i in range(1, _TAGS):
        total = total + differing(i)
    return F.lit(COORDINATES) - total


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sorted by b, a leader's set is built once."""

    def run(batches):
        last, last_set = None, np.empty(0, _U)
        for batch in batches:
            b_column = batch.column(1)
            keep = []
            for i, (b, text_a, text_b) in enumerate(
                zip(b_column.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ):
                if (b, text_b) != last:
                    last, last_set = (b, text_b), shingle_set(text_b, k)
                one = shingle_set(text_a, k)
                shared = len(np.intersect1d(one, last_set, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(last_set) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    kind = dict(pairs.dtypes)["a"]
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and parted by ASCII white space. Documents are linked when the
    Jaccard similarity of their sets of distinct k-word shingles is at least `percent` / 100; a
    document of fewer than k words has its whole sequence as one shingle. `component_id` is the
    smallest identifier reachable over links and `kept` marks the row that has it. NULL or empty
    texts are linked with nothing. Rows that repeat an identifier are one document. Rows without
    an identifier are linked with nothing and kept, with a NULL component. An empty table gives
    an empty result; other columns are ignored. `percent` is 80 or more: banding is made for it.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(plain.dtypes)["id"]
    id_field = pa.field("id", _arrow_type(spark, plain))
    sketched = settle(
        plain.mapInArrow(_sketch_batches(k, id_field), f"id {kind}, {_DDL}"), "sketches"
    )

    usable = sketched.where("n > 0 AND id IS NOT NULL")
    classes = settle(
        usable.groupBy("digest", "n").agg(
            F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("tags").alias("tags")
        ),
        "classes",
    )
    same = usable.select("id", "digest", "n").join(classes.select("digest", "n", "rep"), ["digest", "n"])
    edges = settle(same.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), "copies")

    # Buckets of one class propose nothing; the others are written once for all rounds.
    members = classes.select("rep", _key(), "n", "tags", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    buckets = settle(members.join(shared, "bucket"), "buckets")
    texts = settle(
        plain.join(buckets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts"
    )

    state = buckets.select(
        "*",
        F.col("rep").alias("component"),
        F.lit(0).cast("bigint").alias("own"),
        F.lit(None).cast("array<bigint>").alias("fine"),
    )
    # First the smallest class leads every bucket, which proposes few different pairs; then any.
    for order in (F.col("rep"), F.xxhash64("rep", "bucket")):
        lead = F.col("leader")
        leaders = (
            state.groupBy("bucket")
            .agg(
                F.min_by(F.struct("rep", "n", "own", "tags", "fine", "component"), F.struct(order.alias("order"), "rep")).alias("leader"),
                F.min("component").alias("least"),
                F.max("component").alias("most"),
            )
            .where("least <> most")
            .select("bucket", "leader")
        )
        pairs = (
            state.join(leaders, "bucket")
            .where(
                (F.col("component") != lead["component"])
                & _similar_sizes(F.col("n"), lead["n"], percent)
                & _may_share(F.col("n"), F.col("own"), lead["n"], lead["own"], percent)
                & (_equal_tags(F.col("tags"), lead["tags"]) >= FEWEST_EQUAL)
                & _fine_enough(F.col("fine"), lead["fine"])
            )
            .select(F.col("rep").alias("a"), lead["rep"].alias("b"))
            .distinct()
        )
        edges = edges.union(settle(_verified(pairs, texts, k, percent), "verified"))
        state = _mixed(state, edges, texts, k)

    # What is left: members of different components that share a bucket, each pair in the first one.
    # That bucket is still there: it has held both of their components all the time.
    state = state.join(classes.select("rep", _key(), "bands"), ["rep", "key"])
    a, b = state.alias("a"), state.alias("b")
    first_shared = F.get(F.array_intersect("a.bands", "b.bands"), F.lit(0))
    rest = (
        a.join(
            b,
            (F.col("a.bucket") == F.col("b.bucket"))
            & (F.col("a.rep") < F.col("b.rep"))
            & (F.col("a.component") != F.col("b.component"))
            & _similar_sizes(F.col("a.n"), F.col("b.n"), percent)
            & _may_share(F.col("a.n"), F.col("a.own"), F.col("b.n"), F.col("b.own"), percent)
            & (_equal_tags(F.col("a.tags"), F.col("b.tags")) >= FEWEST_EQUAL)
            & _fine_enough(F.col("a.fine"), F.col("b.fine"))
            & (F.col("a.bucket") == first_shared),
        )
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
        .distinct()
    )
    edges = edges.union(settle(_verified(rest, texts, k, percent), "verified"))

    found = components(edges)
    joined = sketched.select("id", "n").join(found, F.col("id") == F.col("member"), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def _mixed(state: DataFrame, edges: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Members of buckets that still hold several components, with `component`, `own`, `fine` brought up to date."""
    found = components(edges)
    now = settle(
        state.drop("component", "own", "fine")
        .join(found, F.col("rep") == F.col("member"), "left")
        .withColumn("component", F.coalesce("component", "rep"))
        .drop("member"),
        "state",
    )
    several = (
        now.groupBy("bucket")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least <> most")
        .select("bucket")
    )
    open_ = settle(now.join(several, "bucket"), "mixed")
    own, fine = _own_shingles(texts, open_, k), _fine_sketches(texts, open_, k)
    told = open_.join(own, ["rep", "key"], "left").join(fine, ["rep", "key"], "left")
    return settle(told.withColumn("own", F.coalesce("own", F.lit(0))), "state")


def _arrow_type(spark, frame: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema["id"].dataType)
