"""Media columns: interleaved document sequences whose media are resolved by digest.

HTML parsing yields, in document order, text items and media references (digest and
caption). Payloads are stored losslessly as 8-bit grey PNG in a media table keyed by
the payload's SHA-256; a join on the digest resolves the references. The position of
an item is fixed at parsing, so captions and media stay aligned whatever the join does.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import common

WIDTH = 576
TAIL = 32
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
#: A sequence without its texts: how long each text is, and digest and caption of each medium, in order.
LAYOUT = "array<struct<position:int,kind:string,n_chars:int,digest:string,caption:string>>"
STORED = f"doc_id bigint, n_bytes bigint, digest string, media binary, n_items int, sequence {LAYOUT}, refs array<{ITEM}>"
READ_BACK = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td", "th", "article", "section", "figure", "figcaption", "br", "title"}


def pad(raw: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of WIDTH."""
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def png(samples: bytes) -> bytes:
    """Store bytes as the samples of a grey image of WIDTH columns."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def samples_of(image: bytes) -> bytes:
    """Read the samples of an image that :func:`png` stored."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, body, width, height = 8, [], 0, 0
    while at < len(image):
        size, name = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(name + data) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk of the PNG is damaged")
        if name == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey is stored here")
        elif name == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are stored here")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A 64-bit mean hash over 64 equal parts, with mean and spread of the samples."""
    values = np.frombuffer(samples, np.uint8)
    parts = values.reshape(64, -1).mean(axis=1)
    bits = int.from_bytes(np.packbits(parts > values.mean()).tobytes(), "big")
    return f"{bits:016x}:{values.mean():.3f}:{values.std():.3f}"


class Sequence(HTMLParser):
    """Collects a page's text and media references in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipped = 0
        self.figure: dict | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.text).strip()
        self.text.clear()
        if text:
            self.add("text", text, None, None)

    def add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> dict:
        item = {"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption}
        self.items.append(item)
        return item

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skipped += 1
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            found = dict(attrs)
            source = found.get("src") or ""
            item = self.add("media", None, source.removeprefix("sha256:") if source.startswith("sha256:") else source, found.get("alt"))
            self.figure = item
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = "".join(self.caption).strip(), None
            if self.figure is not None:
                self.figure["caption"] = text or self.figure["caption"]
            elif text:
                self.add("text", text, None, None)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    """Parse one page into its ordered items; a null page has none."""
    parser = Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def parse_pages(pages: DataFrame, column: str = "html", out: str = "items") -> DataFrame:
    """Add the ordered items of an HTML column; a null page gets an empty array."""
    fields = [f for f in pages.schema.fields if f.name != out]
    names = [f.name for f in fields]
    kinds = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sequence(page.as_py()) for page in batch.column(column)], kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<{ITEM}>"
    return pages.select(*names).mapInArrow(run, schema)


def document_page(text: str, digest: str) -> str:
    """A document as a page: its lines as paragraphs, its bytes as a captioned figure."""
    lines = text.split("\n")
    body = "".join([f"<p>{html.escape(line, quote=False)}</p>" for line in lines])
    return f'<article>{body}<figure><img src="sha256:{digest}" alt="bytes"><figcaption>{len(lines)} lines</figcaption></figure></article>'


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn (doc_id, text) into stored media and the references of the document's page."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sizes, digests, images, counts, layouts, refs = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                raw = (text or "").encode()
                payload = pad(raw)
                digest = hashlib.sha256(payload).hexdigest()
                items = sequence(document_page(text or "", digest))
                sizes.append(len(raw))
                digests.append(digest)
                images.append(png(payload))
                counts.append(len(items))
                layouts.append([{"position": x["position"], "kind": x["kind"], "n_chars": len(x["text"]) if x["text"] else None, "digest": x["digest"], "caption": x["caption"]} for x in items])
                refs.append([x for x in items if x["kind"] == "media"])
            kinds = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
            laid = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("n_chars", pa.int32()), ("digest", pa.string()), ("caption", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(images, pa.binary()), pa.array(counts, pa.int32()), pa.array(layouts, laid), pa.array(refs, kinds)], ["doc_id", "n_bytes", "digest", "media", "n_items", "sequence", "refs"])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode stored media and compute what is known of each payload."""
    for batch in batches:
        rows = []
        for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media")):
            stored = image.as_py()
            payload = samples_of(stored)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_documents(docs: DataFrame) -> DataFrame:
    """Write the media table of all documents to the shared folder and return it.

    ``sequence`` is the document's whole interleaved sequence, with lengths for texts.
    A null text counts as empty and is stored as one line of padding. Repeated rows
    are stored once for each row; equal texts have equal digests and equal media.
    """
    return common.materialize(docs.select("doc_id", "text").mapInArrow(store, STORED), "media")


def resolve(sequences: DataFrame, stored: DataFrame | None = None, items: str = "refs") -> DataFrame:
    """One row for each item of each sequence, with what a media item's payload holds.

    ``sequences`` has any columns and one of items, as :func:`parse_pages` makes them
    (columns named like an item's or a payload's field give way to those);
    ``stored`` has digest and media and is ``sequences`` itself if not given. Text items
    and references without a stored payload stay at their positions with nulls for the
    payload; a sequence without items gives no row. Copies of a payload are reduced to
    one row before the join. The join has the digest's beginning as a second key, so
    that it is dealt anew and a digest which very many documents refer to is split by
    the engine rather than dealt to one task.
    """
    held = (sequences if stored is None else stored).select("digest", "media").mapInArrow(read_back, READ_BACK)
    once = held.groupBy("digest").agg(*(F.first(c).alias(c) for c in held.columns if c != "digest"))
    fields = ["position", "kind", "text", "digest", "caption"]
    payload = [c for c in once.columns if c != "digest"]
    keep = [c for c in sequences.columns if c not in {items, "media", *fields, *payload}]
    found = sequences.select(*keep, F.explode(items).alias("_item")).select(*keep, *(F.col(f"_item.{f}").alias(f) for f in fields))
    # items without a digest join with nothing; each has a key of its own, so that they are not dealt to one task
    to = F.coalesce("digest", F.concat(F.lit("-"), F.xxhash64(*fields, F.monotonically_increasing_id()).cast("string")))
    left = found.withColumns({"_digest": to, "_head": F.substring(to, 1, 8)})
    right = once.withColumns({"_digest": F.col("digest"), "_head": F.substring("digest", 1, 8)}).drop("digest")
    return left.join(right, ["_digest", "_head"], "left").select(*keep, *fields, *payload)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's bytes as media, read them back and describe them."""
    found = resolve(store_documents(common.read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "sequence")
