"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding reads symbols from left to right and emits a token as soon as no text that
may still follow can change it. How far ahead that takes is computed from the merge
list, for each token (:func:`sufficient_lookahead`). A text is read in chunks, and a
word of any length goes through the transducer part by part, so that beside the row
itself only one chunk and the lookahead are held. Decoding turns ids into text through
a state machine that keeps at most one unfinished UTF-8 sequence.

Words repeat, so what the transducer gave for a short word is kept in a bounded table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from termweave.llm import common

TOKENIZER = "word_bpe_49k.json"
KEPT_PIECES = 400_000
LONGEST_KEPT = 64
#: Symbols beyond the lookahead that are merged at a time; characters that are read at a time.
BLOCK, CHUNK = 256, 1 << 16
NEVER = 1 << 30
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], size: Callable[[str], int] = len) -> dict[str, int]:
    """For each token, the symbols after its end that can still change it.

    A token t at the end of what was read changes only if a merge (u, w) takes place
    whose u is t, or was the last part of t for a while (t's last part, that one's last
    part, and so on, each until t's own merges used it up), and whose w lies behind t.
    Whether w forms there in time depends on what is behind w in the same way, by
    strictly earlier merges only. So one pass over the list finds the longest chain:
    ``reach`` is the most symbols that merges so far take behind a left part, ``inside``
    the same for the last parts of a token up to when they were used up.
    """
    reach: dict[str, int] = {}
    inside: dict[str, int] = {}
    for u, w in merges:
        behind = max(reach.get(w, 0), inside.get(w, 0))
        reach[u] = max(reach.get(u, 0), size(w) + behind)
        inside[u + w] = max(inside.get(u + w, 0), behind)
    return {t: max(reach.get(t, 0), inside.get(t, 0)) for t in reach.keys() | inside.keys()}


class Bpe:
    """A vocabulary with merges, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {pair: (rank, pair[0] + pair[1]) for rank, pair in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for token, at in [*self.vocab.items(), *self.added.items()]:
            self.tokens[at] = token.encode()
        self.alphabet = byte_alphabet()
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # \s is spelt out: the pattern language of the file counts no separators 1C-1F as space
        self.words = regex.compile(splits[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}"))
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.ahead = sufficient_lookahead(pairs, self.size)
        self.lookahead = max(self.ahead.values(), default=0)
        self.kept: dict[str, bytes] = {}

    def size(self, token: str) -> int:
        """Number of symbols of a token; the end-of-word mark is part of the last one."""
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply all merges, the earliest first and from the left among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, get = self.ranks, self.ranks.get
        if n <= 40:
            order = [hit[0] if (hit := get(pair)) else NEVER for pair in zip(symbols, symbols[1:])]
            while (least := min(order, default=NEVER)) < NEVER:
                at = order.index(least)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                del order[at]
                if at:
                    order[at - 1] = hit[0] if (hit := get((symbols[at - 1], symbols[at]))) else NEVER
                if at < len(order):
                    order[at] = hit[0] if (hit := get((symbols[at], symbols[at + 1]))) else NEVER
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[pair][0], at, pair[0], pair[1]) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        heapq.heapify(heap)
        parts: list[str | None] = list(symbols)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            to = after[at]
            if parts[at] != left or to < 0 or parts[to] != right:
                continue
            parts[at], parts[to] = left + right, None
            after[at] = after[to]
            if after[at] >= 0:
                before[after[at]] = at
            for x, y in ((before[at], at), (at, after[at])):
                if x >= 0 and y >= 0 and (hit := get((parts[x], parts[y]))):
                    heapq.heappush(heap, (hit[0], x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def ids(self, tokens: Iterable[str]) -> bytes:
        """Packed ids of tokens; symbols without an id are left out, as the library does."""
        found = [at for t in tokens if (at := self.vocab.get(t)) is not None]
        return struct.pack(f"<{len(found)}I", *found)

    def keep(self, piece: str, packed: bytes) -> None:
        """Keep a piece's ids; the table starts anew when it is full."""
        if len(self.kept) >= KEPT_PIECES:
            self.kept.clear()
        self.kept[piece] = packed

    def piece(self, piece: str) -> bytes:
        """Ids, packed, of a piece of text without white space."""
        packed = self.kept.get(piece)
        if packed is None:
            words = (piece,) if piece.isalpha() else self.words.findall(piece)
            if len(words) > 1 and len(piece) <= LONGEST_KEPT:
                packed = b"".join([self.kept.get(w) or self.piece(w) for w in words])
                self.keep(piece, packed)
                return packed
            packed = b"".join([self.ids(t) for w in words for t in self.word(w)])
            if len(piece) <= LONGEST_KEPT:
                self.keep(piece, packed)
        return packed

    def word(self, word: str) -> Iterator[list[str]]:
        """Tokens of a word as they become stable."""
        machine = Transducer(self)
        for at in range(0, len(word), CHUNK):
            yield machine.push(word[at : at + CHUNK])
        yield machine.finish()

    def parts(self, text: str) -> Iterator[str]:
        """Special tokens and what lies between them."""
        at = 0
        if self.specials and "<|" in text:
            for m in self.specials.finditer(text):
                yield text[at : m.start()]
                yield m[0]
                at = m.end()
        yield text[at:] if at else text

    def encode(self, text: str, chunk: int = CHUNK) -> Iterator[bytes]:
        """Packed little-endian ids of a text, part by part."""
        for part in self.parts(text):
            if part in self.added:
                yield struct.pack("<I", self.added[part])
                continue
            machine: Transducer | None = None  # of a word that the last chunk left open
            for some, goes_on in chunks(part, chunk):
                if machine:
                    more = LETTERS.match(some).end()
                    yield self.ids(machine.push(some[:more]))
                    if more == len(some) and goes_on:
                        continue
                    yield self.ids(machine.finish())
                    machine, some = None, some[more:]
                pieces = re.split(f"[{SPACE}]+", some) if re.search("[\x1c-\x1f]", some) else some.split()
                if goes_on and pieces and (words := self.words.findall(pieces[-1]))[-1][0].isalpha():
                    pieces[-1:] = words[:-1]
                    machine = Transducer(self)
                kept, make = self.kept, self.piece
                yield b"".join([kept.get(p) or make(p) for p in pieces])
                if machine:
                    yield self.ids(machine.push(words[-1]))


LETTERS = regex.compile(r"\p{L}*")
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))


def chunks(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """A text in normalized lower-case chunks, each with whether it ends inside a run of letters.

    Chunks end before white space; where there is none for long, inside a run of
    letters, before one that no normalization joins with what precedes it.
    """
    at = 0
    while at < len(text):
        stop, hard = at + size, False
        if stop < len(text):
            stop, hard = cut(text, at + size // 2, stop)
        some, at = text[at:stop], stop
        if not some.isascii():
            some = unicodedata.normalize("NFC", some).replace("Σ", "σ")
        yield some.lower(), hard


def cut(text: str, least: int, stop: int) -> tuple[int, bool]:
    """The last white space from ``least`` to ``stop``, else the first place from there on that may be cut."""
    for at in range(stop, least, -1):
        if text[at] in BLANKS:
            return at, False
    while stop < len(text):
        c = text[stop]
        if c in BLANKS:
            return stop, False
        # vowel and final jamo are the only letters that join with what precedes them
        if c.isalpha() and unicodedata.category(c)[0] == "L" and not "\u1161" <= c <= "\u11ff" and text[stop - 4 : stop].isalpha():
            return stop, True
        stop += 1
    return stop, False


class Transducer:
    """The symbols of one word in, its tokens out, each once it is stable.

    A token is stable when as many symbols after its end have been read as can still
    change it, and all before it are. No merge crosses the end of an emitted token, so
    what is right of it can be merged alone.
    """

    def __init__(self, model: Bpe) -> None:
        self.model = model
        self.held: list[str] = []

    def push(self, letters: str) -> list[str]:
        """Read some more of the word."""
        alphabet, out = self.model.alphabet, []
        raw = letters.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), BLOCK):
            self.held += [alphabet[b] for b in raw[at : at + BLOCK]]
            if len(self.held) > self.model.lookahead + BLOCK:
                self.emit(out)
        return out

    def emit(self, out: list[str]) -> None:
        """Move what is stable to ``out``; the last symbol may still get the end-of-word mark."""
        done, size, ahead = 0, self.model.size, self.model.ahead
        for token in self.model.merge(self.held[:-1]):
            end = done + size(token)
            if len(self.held) - 1 - end < ahead.get(token, 0):
                break
            out.append(token)
            done = end
        del self.held[:done]

    def finish(self) -> list[str]:
        """The word ends: its last symbol gets the mark and all the rest is stable."""
        if not self.held:
            return []
        self.held[-1] += self.model.suffix
        rest, self.held = self.model.merge(self.held), []
        return rest


class Decoder:
    """The state machine from ids to text; its state is the unfinished UTF-8 sequence.

    As the file has no decoder, the text is its tokens joined by blanks, which is what
    the library gives. With ``plain`` the tokens' bytes become text and the end-of-word
    mark a blank. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, model: Bpe, plain: bool = False) -> None:
        self.model, self.plain, self.first = model, plain, True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.back = {c: b for b, c in enumerate(model.alphabet)}
        self.special = set(model.added.values())

    def push(self, ids: Iterable[int]) -> str:
        if self.plain:
            return "".join([self.one(at) for at in ids])
        joined = b" ".join(map(self.model.tokens.__getitem__, ids))
        if joined and not self.first:
            joined = b" " + joined
        self.first &= not joined
        return self.machine.decode(joined)

    def one(self, at: int) -> str:
        """Plain text that one more id completes."""
        token, suffix = self.model.tokens[at].decode(), self.model.suffix
        if at in self.special:
            return self.finish() + token
        ends = bool(suffix) and token.endswith(suffix)
        body = token[: -len(suffix)] if ends else token
        return self.machine.decode(bytes(self.back[c] for c in body)) + (" " if ends else "")

    def finish(self) -> str:
        rest = self.machine.decode(b"", final=True)
        self.machine.reset()
        return rest


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """Read a tokenizer file once in each worker."""
    return Bpe(path)


def digests(model: Bpe, text: str | None, keep: list | None = None) -> tuple[int, str, str]:
    """Token count, digest of the packed ids and digest of the decoded text; ``keep`` gets the ids."""
    ids_hash, text_hash, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(model)
    for packed in model.encode(text or ""):
        ids_hash.update(packed)
        ids = array("I", packed)
        n += len(ids)
        text_hash.update(decoder.push(ids).encode())
        if keep is not None:
            keep.append(ids)
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def digest_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function from (doc_id, text) to the digest columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            got = [digests(model, text.as_py()) for text in batch.column("text")]
            counts, ids, texts = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row's whole text; one row out for each row in.

    A null text counts as empty: no tokens, the digests of nothing. A null doc_id
    stays null; repeated rows stay repeated; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(digest_batches(path), SCHEMA)


def encode_column(docs: DataFrame, path: str, out: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as an array column, replacing a like-named one."""
    fields = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            ids = [array("i", b"".join(model.encode(t.as_py() or ""))).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def encoded_rows(docs: DataFrame, path: str) -> DataFrame:
    """Each row's doc_id, lang and source with its ids and the digest columns.

    One row out for each row in, whatever is null or repeated; a null text has no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids, rows = [], []
                for text in part.column("text").to_pylist():
                    own: list[array] = []
                    rows.append(digests(model, text, own))
                    ids.append(sum(own, array("I")))
                n, digest, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(digest), pa.array(decoded)], ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, "doc_id bigint, lang string, source string, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the public word tokenizer."""
    return token_digests(common.read(spark, sf_dir, "documents"), common.package_path(TOKENIZER))
