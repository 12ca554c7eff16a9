"""MinHash near-dedup with sequential Bayesian verification.

Shingle sets get MinHash signatures; bands of a signature give candidates. A candidate
pair's signatures are compared batch by batch, and the pair is dropped as soon as the
posterior probability that its similarity reaches the threshold falls below the chosen
miss probability. What survives is verified exactly on the full shingle sets.

Groups are never expanded into all pairs. Equal sets are reduced to one member first.
Then each bucket links its members to the smallest one. Only where members of a bucket
stay in different components are they compared across components, in square blocks of
bounded size, which is exact for buckets of any size. Blocks hold sketches only; texts
are fetched for those members that a sketch could not part from all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import common, words
from termweave.llm.components import components

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
SIGNATURE = BANDS * ROWS
THRESHOLD_PERCENT = 80
BATCH = 16
#: Probability of dropping a pair that reaches the threshold, at each batch.
MISS = 1e-9
#: Members of a bucket whose sketches one task compares with as many others', and bytes of texts.
BLOCK, BLOCK_BYTES = 8_192, 16 << 20
#: Members, and bytes of their texts, that one task verifies against their leader's text.
STAR, STAR_BYTES = 512, 32 << 20
SIGNED = "doc_id bigint, n_shingles bigint, set_hash binary, sketch binary, bands array<bigint>"
LINK = "a bigint, b bigint"
_rng = np.random.default_rng(20_240_229)
FACTORS = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes) of each row's distinct shingles, sorted within the row.

    A shingle is ``size`` words in order; a row with fewer words has its whole sequence
    as its only one, and a row without words has none.
    """
    found = words.find(raw, ends, words.NOT_BLANK)
    counts = np.diff(found.bounds)
    n = len(found.hashes)
    if not n:
        return np.zeros(len(counts) + 1, np.int64), found.hashes
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(found.bounds[:-1], counts)
    length = np.minimum(size, counts[row])
    begins = np.flatnonzero(place + length <= counts[row])
    length, row = length[begins], row[begins]
    padded = np.concatenate([found.hashes, np.zeros(size, np.uint64)])
    value = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        value = np.where(k < length, words.mix(value ^ padded[begins + k]) + np.uint64(k), value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
    row, value = row[new], value[new]
    return np.append(np.searchsorted(row, np.arange(len(counts))), len(row)), value


def sign_batches(size: int):
    """Arrow function from (doc_id, text) to set size, set hash, sketch and band keys.

    The sketch has one byte of each minimum, which is enough to compare signatures; the
    keys of the bands are hashes of the whole minima.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = common.text_buffers(batch.column("text"))
            n = len(batch)
            sizes, whole, sign = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64), np.zeros((n, SIGNATURE), np.uint32)
            for a, b in common.runs(ends):
                bounds, sets = shingle_sets(raw, ends[a : b + 1], size)
                sizes[a:b] = np.diff(bounds)
                full = np.flatnonzero(sizes[a:b])
                if len(full):
                    at = bounds[:-1][full]
                    full = full + a
                    for k in range(SIGNATURE):
                        h = sets * FACTORS[k] + OFFSETS[k]
                        sign[full, k] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), at)
                    whole[full, 0] = np.add.reduceat(words.mix(sets + np.uint64(1)), at)
                    whole[full, 1] = np.bitwise_xor.reduceat(words.mix(sets + np.uint64(7)), at)
            none = sizes == 0
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(none, 0, BANDS))), pa.int32()), pa.array(band_keys(sign[~none]).ravel().view(np.int64)))
            hashes = pa.array([None if e else w.tobytes() for w, e in zip(whole, none)], pa.binary())
            sketches = pa.array([None if e else s.tobytes() for s, e in zip(sign.astype(np.uint8), none)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), hashes, sketches, bands], ["doc_id", "n_shingles", "set_hash", "sketch", "bands"])

    return run


def band_keys(sign: np.ndarray) -> np.ndarray:
    """The bucket of each band of some signatures."""
    rows = sign.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for k in range(ROWS):
        keys = words.mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, k])
    return keys


@lru_cache
def least_agreeing(threshold: float, miss: float) -> np.ndarray:
    """For each number of compared positions, the fewest that must agree to go on.

    With a uniform prior the similarity's posterior after m of n agree is Beta(m + 1,
    n - m + 1). The pair is pruned where the posterior mass at or above the threshold
    is below ``miss``. That mass is the chance of at most m successes in n + 1 trials of
    probability ``threshold``.
    """
    least = np.zeros(SIGNATURE + 1, np.int64)
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        mass = 0.0
        for m in range(n + 1):
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                least[n] = m
                break
    return least


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Indices of pairs (rows of a and b) that no batch of positions prunes."""
    alive, agreed, least = np.arange(len(a)), np.zeros(len(a), np.int64), least_agreeing(threshold, miss)
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        agreed = agreed + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        keep = agreed >= least[n]
        alive, agreed = alive[keep], agreed[keep]
        if not len(alive):
            break
    return alive


def sketches(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches of a binary column as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def sets_of(column: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    raw, ends = common.text_buffers(column)
    sets: list[np.ndarray] = []
    for a, b in common.runs(ends):
        bounds, values = shingle_sets(raw, ends[a : b + 1], size)
        sets += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
    return sets


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(one) or not len(two):
        return False
    shared = int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def links_of(rows: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*rows) if rows else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verify_star(percent: int, size: int):
    """Function on one leader's row (b null) and members: those that are linked with it.

    Members go through the sequential test on sketches; what it leaves is verified on
    full sets.
    """

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("b").is_valid().to_numpy(zero_copy_only=False), kind="stable")
        rows = rows.take(pa.array(order))
        if len(rows) < 2:
            return links_of([])
        marks, ids = sketches(rows.column("sketch")), rows.column("b").to_pylist()
        likely = 1 + survivors(np.broadcast_to(marks[0], (len(marks) - 1, SIGNATURE)), marks[1:], percent / 100)
        sets = sets_of(rows.column("text").take(pa.array(np.append(0, likely))), size)
        lead = rows.column("a")[0].as_py()
        return links_of([(lead, ids[k]) for k, own in zip(likely, sets[1:]) if linked(sets[0], own, percent)])

    return run


def verify(pairs: DataFrame, held: DataFrame, percent: int, size: int) -> DataFrame:
    """Keep the (a, b) pairs whose full shingle sets reach the threshold.

    Members of one leader a are dealt to parts of bounded rows and bytes, each with a
    copy of the leader's row, so a leader with very many members needs no large task.
    """
    facts = held.select("doc_id", "sketch", "text")
    counts = pairs.join(held.select(F.col("doc_id").alias("b"), F.octet_length("text").alias("bytes")), "b").groupBy("a").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts = common.materialize(counts.select("a", "n", F.greatest(F.ceil(F.col("n") / STAR), F.ceil(F.col("bytes") / STAR_BYTES)).cast("int").alias("parts")), "parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    dealt = common.join_hot(pairs, parts, "a", "n", total)
    members = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.col("b").alias("doc_id"))
    leaders = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), F.col("a").alias("doc_id"))
    full = members.unionByName(leaders).join(facts, "doc_id").select("a", "part", "b", "sketch", "text")
    return full.groupBy("a", "part").applyInArrow(verify_star(percent, size), LINK)


MEMBER = "bucket bigint, band int, doc_id bigint, component_id bigint"


def tile_pairs(rows: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a tile: the other side's rows in other components that no sketch parts from it.

    A pair is looked at in the bucket of the first band that it shares, so once in all.
    """
    side, ids, comp = (rows.column(c).to_numpy() for c in ("side", "doc_id", "component_id"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    marks, band = sketches(rows.column("sketch")), rows.column("band")[0].as_py()
    keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :band]
    for i in left:
        at = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) if same else True)]
        at = at[survivors(np.broadcast_to(marks[i], (len(at), SIGNATURE)), marks[at], percent / 100)]
        yield i, at[(keys[at] != keys[i]).all(axis=1)]


def open_members(percent: int):
    """Function on one tile of sketches: the rows that take part in any pair to be verified."""

    def run(rows: pa.Table) -> pa.Table:
        part = np.zeros(len(rows), bool)
        for i, at in tile_pairs(rows, percent):
            part[at] = True
            part[i] |= len(at) > 0
        return rows.filter(pa.array(part)).select(["bucket", "band", "doc_id", "component_id"])

    return run


def compare_tile(percent: int, size: int):
    """Function on one tile with texts: links that join components.

    Pairs within one component are not looked at again, nor those that a link found
    here has joined.
    """

    def run(rows: pa.Table) -> pa.Table:
        ids, comp = rows.column("doc_id").to_numpy(), rows.column("component_id").to_numpy().copy()
        sets, found = sets_of(rows.column("text"), size), []
        for i, at in tile_pairs(rows, percent):
            for k in at:
                if comp[k] != comp[i] and linked(sets[i], sets[k], percent):
                    found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                    comp[comp == comp[k]] = comp[i]
        return links_of(found)

    return run


def tiles(member: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Deal each bucket's members to its k (k + 1) / 2 tiles: block x with block y."""
    blocks = common.join_hot(member, groups, "bucket", "n", total).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("k")).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least(x, "own").alias("x"), F.greatest(x, "own").alias("y"), F.when(x < F.col("own"), 1).otherwise(0).alias("side")))
    dealt = blocks.select("bucket", "band", "doc_id", "component_id", F.explode(every).alias("tile"))
    return dealt.select("bucket", "band", "tile.x", "tile.y", "tile.side", "doc_id", "component_id")


def cross_links(buckets: DataFrame, held: DataFrame, labels: DataFrame, percent: int, size: int) -> DataFrame:
    """Verified links between a bucket's members that are in different components.

    The bucket's pairs with its smallest member have been verified before; so buckets
    of two, or of one component, are done. Sketches are compared in tiles of 2 · BLOCK
    members, whatever a bucket holds. The members that no tile can settle meet again
    with their texts, in tiles of about 2 · BLOCK_BYTES, and only links leave these.
    """
    member = buckets.select("bucket", "band", "doc_id").join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    groups = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("n > 2 and lo < hi")
    groups = common.materialize(groups.select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "open")
    total = groups.agg(F.sum("n")).first()[0] or 0
    marked = tiles(member, groups, total).join(held.select("doc_id", "sketch", "bands"), "doc_id")
    left = marked.groupBy("bucket", "x", "y").applyInArrow(open_members(percent), MEMBER).distinct()
    left = common.materialize(left, "unsettled")
    sizes = left.join(held.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = common.materialize(sizes.select("bucket", "n", F.ceil((F.col("bytes") + 1) / BLOCK_BYTES).cast("int").alias("k")), "unsettled")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    full = tiles(left, sizes, total).join(held.select("doc_id", "sketch", "bands", "text"), "doc_id")
    return full.groupBy("bucket", "x", "y").applyInArrow(compare_tile(percent, size), LINK)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Give each document its set size, its component and whether it stays.

    One row comes out for each row of (doc_id, text). Rows without doc_id stay, have no
    component and are linked with nothing. Rows that repeat a doc_id are one document
    with the least of their texts, and all get its result. Null, empty and blank texts
    have no shingles and are linked with nothing. An empty table gives an empty one.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return distinct_documents(docs, shingle_words, percent)
    first = named.groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", "text"))
    judged = distinct_documents(common.materialize(first, "first"), shingle_words, percent)
    return named.select("doc_id").join(judged, "doc_id").unionByName(judged.where(F.col("doc_id").isNull()))


def distinct_documents(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The same for documents without repeated doc_ids."""
    signed = common.materialize(docs.select("doc_id", "text").mapInArrow(sign_batches(shingle_words), SIGNED), "signed")
    # equal sets: one member stands for all
    alike = signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    stands = common.materialize(alike.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "stands")
    once = alike.join(stands.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = common.materialize(once.select("doc_id", F.posexplode("bands").alias("band", "bucket")), "banded")
    shared = common.materialize(banded.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    buckets = common.materialize(common.join_hot(banded, shared, "bucket", "n", total).select("bucket", "band", "doc_id", "a"), "buckets")
    common.release(banded, shared)
    pairs = common.materialize(buckets.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    # what is compared from here on: the sketch, band keys and text of each member of a bucket
    member = common.materialize(buckets.select("doc_id").distinct(), "members")
    held = common.materialize(member.join(signed.select("doc_id", "sketch", "bands"), "doc_id").join(docs.select("doc_id", "text"), "doc_id"), "held")
    links = common.materialize(verify(pairs, held, percent, shingle_words), "found")
    labels = components(links)
    more = common.materialize(cross_links(buckets, held, labels, percent, shingle_words), "across")
    common.release(buckets, pairs, member, held)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return label_all(signed, stands, labels)


def label_all(signed: DataFrame, stands: DataFrame, labels: DataFrame) -> DataFrame:
    """Bring the representatives' components back to all documents.

    Equal sets can be very many; those are joined where they are.
    """
    found = stands.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
    of_set = F.struct("set_hash", "n_shingles").alias("set")
    named = common.materialize(found.select(of_set, F.coalesce("component_id", "rep").alias("component_id"), "copies"), "named")
    rows = signed.select("doc_id", "n_shingles", "set_hash")
    linked = F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull()
    total = named.agg(F.sum("copies")).first()[0] or 0
    met = common.join_hot(rows.where(linked).select("doc_id", of_set), named, "set", "copies", total).select("doc_id", "set.n_shingles", "component_id")
    alone = rows.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on shingles of four words."""
    return near_duplicates(common.read(spark, sf_dir, "documents"), shingle_words=4)


OP2_SQL = r"""
WITH RECURSIVE
words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
arcs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN arcs l ON l.a = r.to_id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept
FROM documents d JOIN (SELECT doc_id, min(to_id) AS least FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN sizes z USING (doc_id)
"""
