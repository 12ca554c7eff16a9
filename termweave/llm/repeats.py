"""Suffix-array dedup: repeated byte strings found with run-length indexes.

A string of LENGTH bytes that also starts earlier in the corpus is a repeat. The corpus
is cut so that equal strings meet and no task needs more than its share:

1. Each string has an anchor, the K bytes in it with the least hash. Strings that follow
   each other and have one anchor form a segment. Equal strings have equal anchors, so a
   repeat's copies meet in the bucket of their anchor.
2. Segments of equal content (64 bits of hash beside the anchor's 48) are reduced to the
   first; the others are repeats. Anchors that still have different contents need their
   bytes compared. An anchor that very many documents have is not dealt to one task: its
   segments are taken apart and each string is dealt by its own hash.
3. Each bucket of such segments gets a run-length index: the Burrows-Wheeler transform
   of its text, kept as runs with suffix-array samples at the ends of runs. From the
   samples alone, matching statistics are streamed: for each place the length of its
   match and where the match is. Strings whose match is long enough are chained to
   their earliest equal.
4. Documents meet their repeated ranges and lose the bytes covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import common
from termweave.llm.words import mix

LENGTH = 100
K = 24
WINDOW = LENGTH - K + 1
#: Bytes of text that one bucket stands for.
BUCKET_BYTES = 6 << 20
#: Segments of one anchor that one index takes; beyond, each string is dealt by itself.
CROWD = 16_384
#: Segments of one anchor in a batch that are counted; anchors that are taken apart, at most.
HEAVY, MOST_HOT = 8, 100_000
PIECE = 1 << 18
NO_ID = -(1 << 63)
PLACE_BITS = np.uint64(20)
PLACE = np.uint64((1 << 20) - 1)
SEGMENTS, RANGES, STRINGS, COUNTS = 0, 1, 2, 3
ROW = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])
ARROW_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP, OTHER_STEP = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
MOST_BYTES = 1 << 20


@lru_cache
def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    step = np.full(n, base, dtype=np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


class Segments(NamedTuple):
    """Runs of strings with one anchor: the first string's start and how many follow."""

    anchor: np.ndarray  # 48 bits
    content: np.ndarray  # 64 bits
    doc: np.ndarray
    start: np.ndarray
    more: np.ndarray


def pack(*columns: np.ndarray) -> bytes:
    """Columns one after the other, wide ones by their low, middle and high parts."""
    return b"".join([np.uint32(len(columns[0])).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def low48(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def pack_segments(s: Segments) -> bytes:
    return pack(low48(s.anchor), s.content.astype("<u8"), s.doc.astype("<i8"), (s.start & 0xFFFF).astype("<u2"), (s.start >> 16).astype("<u2"), s.more.astype(np.uint8))


def unpack_segments(blob: bytes) -> Segments:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 4).reshape(n, 6)
    content, doc = np.frombuffer(blob, "<u8", n, 4 + 6 * n), np.frombuffer(blob, "<i8", n, 4 + 14 * n)
    low, high = np.frombuffer(blob, "<u2", n, 4 + 22 * n), np.frombuffer(blob, "<u2", n, 4 + 24 * n)
    return Segments(wide.view("<u8").ravel(), content, doc, low.astype(np.int64) | high.astype(np.int64) << 16, np.frombuffer(blob, np.uint8, n, 4 + 26 * n).astype(np.int64))


def pack_ranges(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Byte ranges of documents, those that touch or overlap made one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + size)[order]
    if len(doc):
        step = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(stop.max()) + 2)
        reach = np.maximum.accumulate(stop + step)
        new = np.append(True, (start + step)[1:] > reach[:-1])
        first = np.flatnonzero(new)
        stop = np.maximum.reduceat(stop, first)
        doc, start = doc[first], start[first]
    return pack(doc.astype("<i8"), start.astype("<i4"), (stop - start).astype("<i4"))


def unpack_ranges(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    return np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<i4", n, 4 + 8 * n).astype(np.int64), np.frombuffer(blob, "<i4", n, 4 + 12 * n).astype(np.int64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of at most MOST_BYTES bytes, to take those of ranges from."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes[data] * powers(STEP, MOST_BYTES + 1)[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Content hashes of byte ranges; equal contents have equal hashes anywhere."""
    return mix((sums[stop] - sums[start]) * powers(STEP, MOST_BYTES + 1)[MOST_BYTES - start] + (stop - start).astype(np.uint64))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded.tobytes(), strides=(1,))


def cut(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, doc: np.ndarray, shift: np.ndarray) -> Segments:
    """Segments of documents whose bytes lie at begin:stop; ``shift`` is added to starts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    w = words_at(data)
    n = len(data) - K + 1
    grams = mix(w[:n] * np.uint64(0x9FB21C651E98DF25) ^ (w[8 : n + 8] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[16 : n + 16] * np.uint64(0x165667B19E3779F9))
    least = grams & ~PLACE | np.arange(n, dtype=np.uint64)
    have = 1
    while have < WINDOW:
        ahead = min(have, WINDOW - have)
        least = np.minimum(least[:-ahead], least[ahead:])
        have += ahead
    place = (least & PLACE).astype(np.int64)
    count = np.maximum(0, stop - begin - LENGTH + 1)
    full = np.flatnonzero(count)
    if not len(full):
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    owner = np.repeat(full, count[full])
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count[full]) - count[full], count[full]) + begin[owner]
    anchor = place[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(at))) - 1
    start, own = at[first], owner[first]
    content = range_hashes(prefix_hashes(data), start, start + more + LENGTH)
    return Segments(grams[anchor[first]] >> np.uint64(16), content, doc[own], start - begin[own] + shift[own], more)


def pieces(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in groups of about PIECE bytes as (row, begin, stop, shift).

    A longer row is taken in pieces that overlap by LENGTH - 1 bytes, so that each of
    its strings starts in exactly one.
    """
    for a, b in common.runs(ends, PIECE):
        if b == a + 1 and ends[b] - ends[a] > 2 * PIECE:
            for at in range(ends[a], ends[b], PIECE):
                yield np.array([a]), np.array([at]), np.array([min(at + PIECE + LENGTH - 1, ends[b])]), np.array([at - ends[a]])
        else:
            yield np.arange(a, b), ends[a:b], ends[a + 1 : b + 1], np.zeros(b - a, np.int64)


def reduce_equal(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first segment of each content, by anchor and content, and of the rest.

    Segments at one place of one document are the same and do not count as repeats.
    """
    order = np.lexsort((s.start, s.doc, s.content, s.anchor))
    a, c, d, t = s.anchor[order], s.content[order], s.doc[order], s.start[order]
    new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    lead = np.repeat(head, np.diff(np.append(head, len(order)))) if len(order) else head
    again = ~new & ((d != d[lead]) | (t != t[lead])) if len(order) else new
    return order[new], order[again]


def take(s: Segments, at: np.ndarray) -> Segments:
    return Segments(*(c[at] for c in s))


def ids_of(column: pa.Array) -> np.ndarray:
    """doc_ids as an array; nulls as the least number, which no range names."""
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


def home(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document; :func:`home_column` gives the same in a plan."""
    return ((doc ^ doc >> 11 ^ doc >> 23) % n).astype(np.int32)


def home_column(doc: Column, n: int) -> Column:
    return F.pmod(F.coalesce(doc, F.lit(0)).bitwiseXOR(F.shiftright(F.coalesce(doc, F.lit(0)), 11)).bitwiseXOR(F.shiftright(F.coalesce(doc, F.lit(0)), 23)), F.lit(n)).cast("int")


def spread(values: np.ndarray, n: int) -> np.ndarray:
    """Deal keys to n buckets."""
    return (mix(values.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(order) else order
    for a, b in zip(at, np.append(at[1:], len(order))):
        yield int(keys[order[a]]), order[a:b]


def table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    keys, kinds, blobs = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], schema=ARROW_ROW)


def ranges_by_bucket(doc: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    return [(b, RANGES, pack_ranges(doc[at], start[at], size[at])) for b, at in grouped(home(doc, buckets))]


def segment_batches(buckets: int):
    """Arrow function from documents to packed segments, reduced within the batch.

    A row of counts names the anchors with HEAVY or more segments left in the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column("doc_id"))
            raw, ends = common.text_buffers(batch.column("text"))
            parts = [cut(raw[begin[0] : stop[-1]], begin - begin[0], stop - begin[0], ids[row], shift) for row, begin, stop, shift in pieces(ends)]
            if not parts:
                continue
            s = Segments(*(np.concatenate(c) for c in zip(*parts)))
            first, again = reduce_equal(s)
            s, r = take(s, first), take(s, again)
            rows = []
            for b, at in grouped(spread(s.anchor, buckets)):
                own = at[np.lexsort((s.start[at], s.doc[at]))]
                rows.append((b, SEGMENTS, pack_segments(take(s, own))))
            rows += ranges_by_bucket(r.doc, r.start, r.more + LENGTH, buckets)
            anchor, count = np.unique(s.anchor, return_counts=True)
            many = count >= HEAVY
            rows.append((0, COUNTS, pack(np.append(anchor[many], 0).astype("<u8"), np.append(count[many], len(s.anchor)).astype("<u8"))))
            yield from table(rows).to_batches(max_chunksize=64)

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, n) of packed counts; those without an anchor count all segments."""
    for batch in batches:
        for blob in batch.column("blob"):
            raw = blob.as_py()
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            anchor, count = np.frombuffer(raw, "<u8", n, 4), np.frombuffer(raw, "<u8", n, 4 + 8 * n)
            kept = pa.array(anchor.astype(np.int64), pa.int64(), mask=np.arange(n) == n - 1)
            yield pa.RecordBatch.from_arrays([kept, pa.array(count.astype(np.int64))], ["anchor", "n"])


def hot_anchors(packed: DataFrame, crowd: int) -> np.ndarray:
    """Anchors with over ``crowd`` segments and a MOST_HOT-th of all or more, from all batches' counts.

    What a batch has fewer than HEAVY of is not counted, so an anchor that is missed
    here has fewer than HEAVY segments for each batch of documents.
    """
    sums = common.materialize(packed.where(F.col("kind") == COUNTS).select("blob").mapInArrow(counted, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = sums.where("anchor is null").agg(F.sum("n")).first()[0] or 0
    rows = sums.where(F.col("anchor").isNotNull() & (F.col("n") > max(crowd, total // MOST_HOT))).select("anchor").collect()
    return np.array(sorted(r["anchor"] for r in rows), np.uint64)


def take_apart(hot: np.ndarray, buckets: int):
    """Arrow function on packed segments: those of hot anchors are sent to their documents as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
                blob = blob.as_py()
                if kind == SEGMENTS:
                    s = unpack_segments(blob)
                    apart = np.isin(s.anchor, hot)
                    if apart.any():
                        own = take(s, np.flatnonzero(apart))
                        rows += [(to, STRINGS, pack_segments(take(own, at))) for to, at in grouped(home(own.doc, buckets))]
                        blob = pack_segments(take(s, np.flatnonzero(~apart)))
                rows.append((b, kind, blob))
            yield from table(rows).to_batches(max_chunksize=64)

    return run


def meet(buckets: int, crowd: int = CROWD):
    """Arrow function on one bucket of segments: repeats, and what is left to compare.

    Ranges and strings pass through to the bucket of their document. Of segments, all but the first
    of each content are repeats; those first ones are sent to their document's bucket if
    their anchor has more contents than one.
    """

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows.column("kind").to_numpy()
        blobs = [b.as_py() for b in rows.column("blob")]
        out = [(b, int(k), blob) for b, k, blob in zip(rows.column("bucket").to_pylist(), kinds, blobs) if k != SEGMENTS]
        held = [unpack_segments(blob) for k, blob in zip(kinds, blobs) if k == SEGMENTS]
        if held:
            s = Segments(*(np.concatenate(c) for c in zip(*held)))
            first, again = reduce_equal(s)
            out += ranges_by_bucket(s.doc[again], s.start[again], s.more[again] + LENGTH, buckets)
            lead = take(s, first)
            head = np.flatnonzero(np.append(True, lead.anchor[1:] != lead.anchor[:-1]))
            size = np.diff(np.append(head, len(first)))
            many = np.repeat(size, size)
            for kind, chosen in ((SEGMENTS, (many > 1) & (many <= crowd)), (STRINGS, many > crowd)):
                own = take(lead, np.flatnonzero(chosen))
                for b, at in grouped(home(own.doc, buckets)):
                    at = at[np.lexsort((own.start[at], own.doc[at]))]
                    out.append((b, kind, pack_segments(take(own, at))))
        return table(out)

    return run


def fetch(buckets: int):
    """Arrow function joining documents with their segments to compare: packed bytes.

    Strings of crowded anchors are sent one by one, by their own hash; equal ones within
    the task are reduced first.
    """

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows or not docs.num_rows:
            return table([])
        ids = ids_of(docs.column("doc_id"))
        raw, ends = common.text_buffers(docs.column("text"))
        order = np.argsort(ids, kind="stable")
        out = []
        for kind in (SEGMENTS, STRINGS):
            held = [unpack_segments(blob.as_py()) for k, blob in zip(wanted.column("kind").to_pylist(), wanted.column("blob")) if k == kind]
            if not held:
                continue
            s = Segments(*(np.concatenate(c) for c in zip(*held)))
            begin = ends[order[np.searchsorted(ids, s.doc, sorter=order)]] + s.start
            if kind == SEGMENTS:
                for b, at in grouped(spread(s.anchor, buckets)):
                    at = at[np.lexsort((s.start[at], s.doc[at]))]
                    size = s.more[at] + LENGTH
                    where = np.repeat(begin[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    own = take(s, at)
                    out.append((b, SEGMENTS, pack(own.doc.astype("<i8"), own.start.astype("<i4"), size.astype("<i4"), raw[where])))
                continue
            singles = []
            for a in range(0, len(s.doc), 2_048):
                at = np.arange(a, min(a + 2_048, len(s.doc)))
                count = s.more[at] + 1
                which = np.repeat(at, count)
                step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                where = (begin[which] + step)[:, None] + np.arange(LENGTH)
                text = raw[where]
                one = mix((_bytes[text] * powers(STEP, LENGTH)).sum(axis=1, dtype=np.uint64)) >> np.uint64(16)
                two = mix((_bytes[text] * powers(OTHER_STEP, LENGTH)).sum(axis=1, dtype=np.uint64))
                singles.append(Segments(one, two, s.doc[which], s.start[which] + step, np.zeros(len(which), np.int64)))
            s = Segments(*(np.concatenate(c) for c in zip(*singles)))
            first, again = reduce_equal(s)
            out += ranges_by_bucket(s.doc[again], s.start[again], s.more[again] + LENGTH, buckets)
            s = take(s, first)
            out += [(b, STRINGS, pack_segments(take(s, at))) for b, at in grouped(spread(s.anchor, buckets))]
        return table(out)

    return run


class RunIndex(NamedTuple):
    """A run-compressed Burrows-Wheeler transform with samples at the ends of runs.

    Of each run: its symbol and length; the text place of its first row (``at``); that of
    the row before, the last of the previous run (``before``); and how far both agree.
    Sorted by ``at``. Between two samples every place's predecessor in suffix order is
    that of the sample moved along, and its match shorter by as much.
    """

    symbol: np.ndarray
    length: np.ndarray
    at: np.ndarray
    before: np.ndarray
    agree: np.ndarray
    size: int


def suffix_order(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols, rest) of all suffixes of texts that each end in its own mark.

    ``rest`` is the number of bytes up to the mark. Marks come before all bytes and in
    order of their texts. Ranks by seven symbols are doubled until all differ.
    """
    n = len(text) + len(sizes)
    stops = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    inside[stops] = False
    symbols[inside] = text.astype(np.uint64) + np.uint64(1)
    own = np.repeat(np.arange(len(sizes)), sizes + 1)
    rest = stops[own] - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key[: n - k] |= np.where(rest[: n - k] >= k, symbols[k:], np.uint64(0))
    depth = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order, symbols.astype(np.int64), rest
        ahead = np.minimum(np.arange(n) + depth, n - 1)
        second = np.where(rest >= depth, rank[ahead], own)
        key = rank.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        depth *= 2


def build(text: np.ndarray, sizes: np.ndarray) -> RunIndex:
    """Build the index of texts lying one after the other."""
    order, symbols, rest = suffix_order(text, sizes)
    n = len(order)
    last = symbols[order - 1]
    head = np.flatnonzero(np.append(True, (last[1:] != last[:-1]) | (last[1:] == 0)))
    at, before = order[head], np.append(-1, order[head[1:] - 1])
    flat = words_at(np.where(symbols > 0, symbols - 1, 0).astype(np.uint8))
    cap = np.where(before < 0, 0, np.minimum(rest[at], rest[before]))
    agree = np.zeros(len(head), np.int64)
    live = np.flatnonzero(cap > 0)
    while len(live):
        x = flat[at[live] + agree[live]] ^ flat[before[live] + agree[live]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        agree[live] += same
        live = live[(same == 8) & (agree[live] < cap[live])]
    agree = np.minimum(agree, cap)
    by = np.argsort(at)
    return RunIndex(last[head], np.diff(np.append(head, n)), at[by], before[by], agree[by], n)


def matching_statistics(index: RunIndex) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of each place's match with its predecessor in suffix order."""
    size = np.diff(np.append(index.at, index.size))
    step = np.arange(index.size) - np.repeat(index.at, size)
    return np.repeat(index.before, size) + step, np.repeat(index.agree, size) - step


def repeats(index: RunIndex, length: int = LENGTH) -> np.ndarray:
    """Places whose string of ``length`` bytes also starts at an earlier place.

    Matches chain all places of one string; halving the chains brings each place to its
    chain's end, by which the earliest of the chain is known.
    """
    to, size = matching_statistics(index)
    long = np.flatnonzero(size >= length)
    root = np.arange(index.size)
    root[long] = to[long]
    while True:
        further = root[root[long]]
        if (further == root[long]).all():
            break
        root[long] = further
    ends = root[long]
    earliest = np.arange(index.size)
    np.minimum.at(earliest, ends, long)
    members = np.unique(np.concatenate([long, ends]))
    return members[members != earliest[root[members]]]


def compare(buckets: int):
    """Arrow function on one bucket of segments with bytes: their repeats."""

    def run(rows: pa.Table) -> pa.Table:
        out, docs, starts, sizes, texts, singles = [], [], [], [], [], []
        for b, kind, blob in zip(rows.column("bucket").to_pylist(), rows.column("kind").to_pylist(), rows.column("blob")):
            blob = blob.as_py()
            if kind == RANGES:
                out.append((b, RANGES, blob))
            elif kind == STRINGS:
                singles.append(unpack_segments(blob))
            else:
                n = int(np.frombuffer(blob, "<u4", 1)[0])
                docs.append(np.frombuffer(blob, "<i8", n, 4))
                starts.append(np.frombuffer(blob, "<i4", n, 4 + 8 * n).astype(np.int64))
                sizes.append(np.frombuffer(blob, "<i4", n, 4 + 12 * n).astype(np.int64))
                texts.append(np.frombuffer(blob, np.uint8, offset=4 + 16 * n))
        if singles:
            s = Segments(*(np.concatenate(c) for c in zip(*singles)))
            _, again = reduce_equal(s)
            out += ranges_by_bucket(s.doc[again], s.start[again], s.more[again] + LENGTH, buckets)
        if docs:
            doc, start, size, text = (np.concatenate(x) for x in (docs, starts, sizes, texts))
            order = np.lexsort((start, doc))
            begin = (np.cumsum(size) - size)[order]
            doc, start, size = doc[order], start[order], size[order]
            place = np.cumsum(size + 1) - size - 1
            where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            found = repeats(build(text[where], size))
            own = np.searchsorted(place, found, side="right") - 1
            at = start[own] + found - place[own]
            out += ranges_by_bucket(doc[own], at, np.full(len(at), LENGTH), buckets)
        return table(out)

    return run


def remove(fields: list[str], digest: bool):
    """Arrow function joining documents with their ranges: what is left of each."""

    def run(docs: pa.Table, marked: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        ids = ids_of(docs.column("doc_id"))
        raw, ends = common.text_buffers(docs.column("text"))
        data, ends = raw[ends[0] : ends[-1]], ends - ends[0]
        delta = np.zeros(len(data) + 1, np.int64)
        order = np.argsort(ids, kind="stable")
        for blob in marked.column("blob"):
            doc, start, size = unpack_ranges(blob.as_py())
            low, high = np.searchsorted(ids, doc, sorter=order), np.searchsorted(ids, doc, side="right", sorter=order)
            for again in range(int((high - low).max(initial=0))):  # rows that repeat a doc_id share its ranges
                ok = low + again < high
                row = order[low[ok] + again]
                np.add.at(delta, np.minimum(ends[row] + start[ok], ends[row + 1]), 1)
                np.add.at(delta, np.minimum(ends[row] + start[ok] + size[ok], ends[row + 1]), -1)
        gone = np.cumsum(delta)[: len(data)] > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = ends[:-1][ends[:-1] < len(data)]
        opens[edge] = gone[edge]
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
        removed, spans = total(gone), total(opens)
        kept = data[~gone]
        left = np.append(0, np.cumsum(np.diff(ends) - removed))
        texts = [kept[a:b].tobytes() for a, b in zip(left[:-1], left[1:])]
        counts = [pa.array(np.diff(ends)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64))]
        if digest:
            own = [f for f in fields if f != "text"]
            shas = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            return pa.table([*(docs.column(f) for f in own), *counts, shas], [*own, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        null = docs.column("text").is_null().to_pylist()
        clean = pa.array([None if x else t.decode("utf-8", "ignore") for t, x in zip(texts, null)], pa.string())
        return pa.table([*(clean if f == "text" else docs.column(f) for f in fields), *counts], [*fields, "n_bytes", "n_removed", "n_spans"])

    return run


def without_repeats(docs: DataFrame, digest: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove from each document the bytes that a repeated string covers.

    Gives all columns with ``text`` reduced (a character that lost some of its bytes goes
    as a whole), or with ``digest`` only doc_id and the digest of the remaining bytes;
    and ``n_bytes``, ``n_removed`` and ``n_spans``, which replace like-named columns.
    "Earlier" means a smaller doc_id, or an earlier start in the same document. Rows
    that repeat a doc_id are documents of their own, those of the lesser text first.
    Rows without doc_id are left as they are and nothing is compared with them. Null and
    empty texts have no bytes; an empty table gives an empty one.
    """
    source = docs.select("doc_id", "text") if digest else docs.drop("n_bytes", "n_removed", "n_spans")
    if source.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty():
        return _without_repeats(source, digest, crowd)
    # numbers that grow with doc_id and text stand for the ids; the written table fixes them
    numbered = source.withColumn("_doc_id", F.col("doc_id")).orderBy("doc_id", "text")
    numbered = common.materialize(numbered.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
    found = _without_repeats(numbered, digest, crowd)
    return found.withColumn("doc_id", F.col("_doc_id")).drop("_doc_id")


def _without_repeats(source: DataFrame, digest: bool, crowd: int) -> DataFrame:
    """The same for documents without repeated doc_ids."""
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4 * common.salted(source.sparkSession), -(-total // BUCKET_BYTES))
    texts = source.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    packed = common.materialize(texts.mapInArrow(segment_batches(n), ROW), "segments")
    hot = hot_anchors(packed, crowd)
    dealt = packed.where(F.col("kind") != COUNTS)
    if len(hot):
        dealt = dealt.mapInArrow(take_apart(hot, n), ROW)
    met = common.materialize(dealt.groupBy("bucket").applyInArrow(meet(n, crowd), ROW), "met")
    common.release(packed)
    # both uses of the documents are one exchange in the plan
    held = source.withColumn("bucket", home_column(F.col("doc_id"), n)).groupBy("bucket")
    fetched = held.cogroup(met.where(F.col("kind") != RANGES).groupBy("bucket")).applyInArrow(fetch(n), ROW)
    compared = fetched.groupBy("bucket").applyInArrow(compare(n), ROW)
    marked = met.where(F.col("kind") == RANGES).unionByName(compared)
    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    if digest:
        schema = T.StructType([*(f for f in source.schema.fields if f.name != "text"), *counts, T.StructField("kept_sha256", T.StringType())])
    else:
        schema = T.StructType([*source.schema.fields, *counts])
    return held.cogroup(marked.groupBy("bucket")).applyInArrow(remove(source.columns, digest), schema)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every string of 100 bytes that also starts earlier from all documents."""
    return without_repeats(common.read(spark, sf_dir, "documents"), digest=True)


OP9_SQL = """
WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS i FROM bytes)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1),
opened AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS opens FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM opened),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, coalesce(last, 0), n FROM bytes LEFT JOIN (SELECT doc_id, max(b) AS last FROM spans GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN bytes USING (doc_id) WHERE y > x GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(k, ''))) AS kept_sha256
FROM bytes LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
