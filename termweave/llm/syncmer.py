"""Document fingerprints: closed syncmers over words, with DataFrame functions only.

A text's words are hashed. Of each run of K words, the inner runs of S = 1 word are
compared by hash; the K-mer is a closed syncmer, and so an anchor, if the smallest of
them is the first or the last. Whether a K-mer is chosen depends on nothing outside it, so equal
passages choose equal anchors wherever they stand.

A fingerprint holds each anchor with the place where it first stands. Two fingerprints
are matched by position: anchors that both have count if they are shifted by about as
much as most others, so passages in another order do not add up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm import common

K = 8
#: Parts of an anchor's number: its hash, and the mark of the second of two fingerprints.
HASH, OTHER = -(1 << 32), 1 << 31
#: Scripts that are written without blanks between words: Thai to Burmese, Khmer, kana and Han (as ranges, which are quick to test).
UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}"
#: Range buckets per shuffle partition for the order of documents, and buckets at most.
BUCKETS_PER_PARTITION, MOST_BUCKETS = 8, 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def neighbours(values: Column, ahead: int, join: Callable[[Column, Column], Column]) -> Column:
    """Join each value with the one ``ahead`` places on; the result is shorter by that."""
    return let(values, lambda v: F.when(F.size(v) > ahead, F.zip_with(F.slice(v, 1, F.size(v) - ahead), F.slice(v, ahead + 1, F.size(v) - ahead), join)).otherwise(F.slice(v, 1, 0)))


def words_of(text: Column) -> Column:
    """Words of a text: characters of scripts without blanks one by one, else runs without white space."""
    spaced = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    single = F.regexp_extract_all(text, F.lit(f"[{UNSPACED}]|[^ \\t-\\r{UNSPACED}]+"), 0)
    return F.when(F.rlike(text, F.lit(f"[{UNSPACED}]")), single).otherwise(spaced)


def anchors(text: Column) -> Column:
    """A text's anchors as numbers: the hash in the upper 32 bits, the word's place below.

    They are sorted, and each hash is there once, with its first place. A text with
    fewer than K words has its single words as anchors; a text without words has none. A
    text of K to 13 words can lack a closed syncmer; all its K-mers are its anchors then,
    so that it still meets near copies that have one.
    """

    def chosen(h: Column, low: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(low) - 1)
        closed = F.filter(every, lambda i: (F.get(low, i) == F.get(h, i)) | (F.get(low, i) == F.get(h, i + (K - 1))))
        at = let(closed, lambda found: F.when(F.size(found) > 0, found).otherwise(every))
        mer = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K)))
        return F.transform(at, lambda i: mer(i).bitwiseAND(HASH).bitwiseOR(i.cast("long")))

    def of_hashes(h: Column) -> Column:
        least = h
        for ahead in (1, 2, 4):  # the least of 2, 4 and then all K = 8 words from each place on
            least = neighbours(least, ahead, lambda a, b: F.least(a, b))
        few = F.transform(h, lambda x, i: F.xxhash64(x).bitwiseAND(HASH).bitwiseOR(i.cast("long")))
        return F.when(F.size(h) >= K, let(least, lambda low: chosen(h, low))).otherwise(few)

    every = let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of_hashes)
    return let(F.sort_array(every), lambda s: F.filter(s, lambda v, i: (i == 0) | (v.bitwiseAND(HASH) != F.get(s, i - 1).bitwiseAND(HASH))))


def likeness(a: Column, b: Column) -> Column:
    """Anchors of both fingerprints at matching places, over all anchors of either.

    Places match if their shift differs from the median shift of all common anchors by
    at most K words and about an eighth of the text (an anchor stands for four words).
    Two texts without words are alike, and like no other.
    """
    both = F.sort_array(F.concat(a, F.transform(b, lambda v: v.bitwiseOR(OTHER))))

    def shifts(m: Column) -> Column:
        # a common anchor's second number follows its first, with the mark
        one = lambda v, w: F.when(v.bitwiseXOR(w).bitwiseAND(HASH) == 0, w - v - OTHER)
        return F.sort_array(F.array_compact(F.zip_with(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, 2, F.size(m)), one)))

    def matched(s: Column) -> Column:
        middle, slack = F.get(s, F.floor(F.size(s) / 2).cast("int")), (K + (F.size(a) + F.size(b)) / 4).cast("long")
        near = let(F.struct((middle - slack).alias("lo"), (middle + slack).alias("hi")), lambda x: F.size(F.filter(s, lambda v: (v >= x["lo"]) & (v <= x["hi"]))))
        every = F.size(a) + F.size(b) - F.size(s)
        return F.when(every == 0, F.lit(1.0)).otherwise(near / every)

    return let(let(both, shifts), matched)


def shown(fingerprint: Column) -> Column:
    """A fingerprint as one string: each anchor's number (hash and place) in 16 hexadecimal digits or fewer."""
    return F.lower(F.array_join(F.transform(fingerprint, F.hex), ","))


NO_ID = -(1 << 63)


def range_of(doc_id: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are below a doc_id, by halving; null counts as least."""
    bits = len(edges).bit_length()
    table = F.array(*(F.lit(e) for e in edges + [(1 << 63) - 1] * ((1 << bits) - 1 - len(edges))))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))
    value = F.coalesce(doc_id, F.lit(NO_ID))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < value, at + step).otherwise(at)) if bits else F.lit(0)


def deal_in_order(docs: DataFrame) -> DataFrame:
    """Deal rows to ranges of doc_id, with a copy of each range's successor.

    The edges of the ranges are approximate quantiles of all doc_ids. Ranges are read
    in descending order; the first row of a range is copied to the range read before it
    (the first of all to the last range), so one exchange is enough for each row to
    meet its successor. Edges and first rows are bounded in number. Adds ``_to`` (the
    range), ``_copy`` and ``_order``. Rows of one doc_id are ordered by their text's
    hash and then text; a null doc_id comes last.
    """
    n = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * common.salted(docs.sparkSession))
    edges = sorted({int(e) for e in docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)})
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("h"))
    ranged = docs.withColumns({"_range": range_of(F.col("doc_id"), edges), "_own": own})
    first = {r["_range"]: r["first"] for r in ranged.groupBy("_range").agg(F.max("_own").alias("first")).collect()}
    used = sorted(first)
    before = {b: used[(i + 1) % len(used)] for i, b in enumerate(used)}
    table = F.array(*(F.struct(F.lit(first[b]["d"]).alias("d"), F.lit(first[b]["h"]).alias("h")) if b in first else F.lit(None).cast("struct<d:bigint,h:bigint>") for b in range(len(edges) + 1)))
    target = F.array(*(F.lit(before.get(b, 0)) for b in range(len(edges) + 1)))
    place = lambda to, copy: F.struct(to.cast("int").alias("to"), F.lit(copy).alias("copy"))
    stays = F.array(place(F.col("_range"), False))
    both = F.array(place(F.col("_range"), False), place(F.get(target, F.col("_range")), True))
    places = F.when(F.get(table, F.col("_range")) == F.col("_own"), both).otherwise(stays)
    return ranged.select(*docs.columns, "_own", F.explode(places).alias("_place")).select(*docs.columns, F.col("_place.to").alias("_to"), F.col("_place.copy").alias("_copy"), F.col("_own").alias("_order")).repartition("_to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each row's text and its edited text and compare them.

    The edited text has its last third replaced by the beginning of the next row's
    text, rows taken by descending doc_id and the last followed by the first. A null
    text counts as empty; a text without words is like another such one only. A single
    row is its own successor. Repeated rows stay repeated.
    """
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = deal_in_order(clean).withColumn("anchors", anchors(F.col("text")))
    down = Window.partitionBy("_to").orderBy(F.col("_copy"), F.desc("_order"), F.desc("text"))
    met = dealt.withColumn("next", F.lead(F.struct("text", "anchors")).over(down)).where(~F.col("_copy"))
    length = F.char_length("text").cast("long")
    cut = F.floor(length / 3).cast("int")
    edited = F.concat(F.left(F.col("text"), (length - cut).cast("int")), F.left(F.col("next.text"), cut))
    made = met.select("doc_id", length.alias("n_chars"), "anchors", F.col("next.anchors").alias("next_anchors"), edited.alias("edited"))
    last = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "anchors", "next_anchors", anchors(F.col("edited")).alias("edited_anchors"))
    return last.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("anchors")).alias("fingerprint"), shown(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text."""
    return fingerprints(common.read(spark, sf_dir, "documents"))
