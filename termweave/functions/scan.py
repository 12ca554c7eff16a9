"""Sentences, words and dictionary matches of whole columns of texts, as array operations.

The same text model as :mod:`termweave.functions.text`, in batches: each text is read
once, and what depends on a word alone is done once for each different word of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from termweave.functions import text
from termweave.functions.stem import stem

#: Bytes of text that are taken at a time.
PIECE = 16 << 20
#: A point inside a word is set apart by HELD, so that all others end sentences.
HELD, MARK = "\x02", text.MARK
INNER_POINT, SENTENCE_END, NO_WORD = r"\.([\p{L}\p{N}_])", "[.?!]", r"[^\p{L}\p{N}_\x02<=]+"


class Words(NamedTuple):
    """The words of some windows, by number, and where each window's words begin."""

    known: pa.Array  # the different words
    codes: np.ndarray  # of words, into ``known``
    bounds: np.ndarray  # of windows, into ``codes``; one more than there are windows
    rows: np.ndarray  # of windows: their row in the batch
    places: np.ndarray  # of windows: their number in the row


class Path(NamedTuple):
    """Lemmas that stand for a term."""

    n: int
    lemmas: tuple[str, ...]
    term: str


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about PIECE bytes of a column of texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sentences(texts: pa.Array) -> Words:
    """The sentences of texts: every end ends one, even an empty one; only an empty last one is dropped."""
    plain = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), HELD, " ")
    ended = pc.replace_substring_regex(pc.replace_substring_regex(plain, INNER_POINT, HELD + r"\1"), SENTENCE_END, MARK)
    parts = pc.split_pattern(ended, MARK)
    split = pc.split_pattern_regex(parts.values, NO_WORD)
    full = pc.greater(pc.binary_length(split.values), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    bounds, first = before[split.offsets.to_numpy()], parts.offsets.to_numpy()
    rows = np.repeat(np.arange(len(texts)), np.diff(first))
    places = np.arange(len(rows)) - first[rows]
    kept = (np.diff(bounds) > 0) | (np.arange(len(rows)) < first[rows + 1] - 1)
    found = pc.dictionary_encode(split.values.filter(full))
    known = pc.replace_substring(found.dictionary, HELD, ".")
    return Words(known, found.indices.to_numpy().astype(np.int64), np.append(bounds[:-1][kept], before[-1]), rows[kept], places[kept])


def given(words: pa.Array, places: pa.Array) -> Words:
    """Windows that are rows of arrays of words."""
    bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    found = pc.dictionary_encode(words.flatten().cast(pa.large_string()))
    return Words(found.dictionary, found.indices.to_numpy().astype(np.int64), bounds, np.arange(len(words)), places.to_numpy())


def each(strings: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """A plain function of each string."""
    return pa.array([change(w) for w in strings.to_pylist()], pa.large_string())


def lower(strings: pa.Array) -> pa.Array:
    """Strings in lower case, with the full mapping of all letters."""
    odd = pc.invert(pc.string_is_ascii(strings))
    return pc.replace_with_mask(pc.ascii_lower(strings), odd, each(strings.filter(odd), str.lower))


LEMMAS: dict[str, Callable[[pa.Array], pa.Array]] = {"identity": lambda s: s, "lower": lower, "stem": lambda s: each(s, stem)}


def lowered(words: Words) -> tuple[pa.Array, np.ndarray]:
    """The different words in lower case, and the number of each word among them."""
    found = pc.dictionary_encode(lower(words.known))
    return found.dictionary, found.indices.to_numpy().astype(np.int64)[words.codes]


def index(strings: pa.Array, among: list[str]) -> np.ndarray:
    """Where each string is in a list, -1 if it is not there."""
    return pc.fill_null(pc.index_in(strings, pa.array(among, pa.large_string())), -1).to_numpy().astype(np.int64)


def row_counts(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers below ``size`` those that occur, and in how many rows."""
    return np.unique(np.unique(rows * size + codes) % size, return_counts=True)


class Matcher:
    """Leftmost-longest matching of windows against paths."""

    def __init__(self, paths: list[Path], how: str, gate: bool) -> None:
        self.paths = sorted(paths)  # of equal ones the last one stands, so the longest does
        self.lemma, self.gate = LEMMAS[how], gate
        self.lemmas = sorted({w for p in paths for w in p.lemmas})
        self.ids = {w: i for i, w in enumerate(self.lemmas)}

    def best(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places with a match, their windows and paths, in order; they may still overlap."""
        codes = index(self.lemma(words.known), self.lemmas)[words.codes]
        free = (index(lower(words.known), list(text.DENIED)) < 0)[words.codes] if self.gate else None
        opens = np.zeros(len(self.ids) + 1, dtype=bool)  # the last for words of no path
        opens[[self.ids[p.lemmas[0]] for p in self.paths]] = True
        at = np.flatnonzero(opens[codes])
        window = np.searchsorted(words.bounds, at, side="right") - 1
        room = words.bounds[window + 1] - at
        order = np.argsort(codes[at], kind="stable")
        firsts = codes[at][order]
        best = np.full(len(at), -1)
        for k, path in enumerate(self.paths):
            lo, hi = np.searchsorted(firsts, self.ids[path.lemmas[0]] + np.arange(2))
            fits = order[lo:hi]
            fits = fits[room[fits] >= path.n]
            for i, lemma in enumerate(path.lemmas):
                if i:
                    fits = fits[codes[at[fits] + i] == self.ids[lemma]]
                if free is not None:
                    fits = fits[free[at[fits] + i]]
            best[fits] = k
        met = best >= 0
        return at[met], window[met], best[met]

    def hits(self, words: Words, ids: pa.Array, shown: bool) -> pa.RecordBatch:
        """(doc_id, win_ix, hits) of windows with matches; if ``shown`` with the texts of those with many."""
        at, window, best = self.best(words)
        sizes = np.array([p.n for p in self.paths])[best]
        taken = leftmost(at, sizes)
        at, window, best, sizes = at[taken], window[taken], best[taken], sizes[taken]
        begins = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(at) else at
        wins = window[begins]
        codes, many = words.codes[at], np.flatnonzero(sizes > 1)
        longer = [" ".join(words.known.take(pa.array(words.codes[at[i] : at[i] + sizes[i]])).to_pylist()) for i in many]
        codes[many] = len(words.known) + np.arange(len(many))
        surfaces = pa.concat_arrays([words.known, pa.array(longer, pa.large_string())]).take(pa.array(codes))
        terms = pa.array([p.term for p in self.paths], pa.string()).take(pa.array(best))
        each = [pa.array((at - words.bounds[window]).astype(np.int32)), pa.array(sizes.astype(np.int32)), terms, surfaces.cast(pa.string())]
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), pa.StructArray.from_arrays(each, ["start", "n", "term", "surface"]))
        out = {"doc_id": ids.take(pa.array(words.rows[wins])), "win_ix": pa.array(words.places[wins].astype(np.int32)), "hits": lists}
        if shown:
            out["sentence"] = names(words, wins, np.diff(np.append(begins, len(at))) > 1)
        return pa.RecordBatch.from_pydict(out)


def leftmost(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of matches in order of their starts, whether no taken one before covers them."""
    ends, taken = starts + sizes, np.ones(len(starts), dtype=bool)
    doubtful = np.append(False, starts[1:] < np.maximum.accumulate(ends)[:-1]) if len(starts) else taken
    end = 0
    for i in np.flatnonzero(doubtful):
        if not doubtful[i - 1]:
            end = ends[i - 1]
        taken[i] = starts[i] >= end
        if taken[i]:
            end = ends[i]
    return taken


def names(words: Words, windows: np.ndarray, chosen: np.ndarray) -> pa.Array:
    """The words of windows joined by blanks, null where not chosen."""
    own = windows[chosen]
    sizes = words.bounds[own + 1] - words.bounds[own]
    ends = np.append(0, np.cumsum(sizes))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - words.bounds[own], sizes)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.known.take(pa.array(words.codes[at]))), pa.scalar(" ", pa.large_string()))
    index = np.where(chosen, np.cumsum(chosen) - 1, 0)
    return joined.take(pa.array(index, mask=~chosen)).cast(pa.string())
