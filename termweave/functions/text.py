"""Scalar text functions: words, sentences, paragraphs and term names, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the text model: word characters, sentence ends, paragraph breaks.
WORD = r"[\p{L}\p{N}_.<=]+"
SENTENCE_END = r"\.(?![\p{L}\p{N}_])|[?!]"
PARAGRAPH_BREAK = r"(?U)\s*\n\s*\n\s*"
#: Fixed closed-class words that a part-of-speech gate denies: determiners, existentials, modals, pronouns, wh-words, adverbs and verb forms.
DENIED = (
    "a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no", "all", "both", "either", "neither", "another", "such",
    "there", "can", "could", "may", "might", "must", "shall", "should", "will", "would", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her",
    "us", "them", "my", "your", "his", "its", "our", "their", "mine", "yours", "hers", "ours", "theirs", "myself", "yourself", "himself", "herself",
    "itself", "ourselves", "themselves", "who", "whom", "whose", "which", "what", "when", "where", "why", "how", "not", "very", "too", "also", "now",
    "then", "here", "never", "always", "often", "just", "only", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "done",
    "has", "have", "had", "having",
)
MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove all white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """All words of a text, markers left out."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def sentences(text: Column, paragraphs: bool = False) -> Column:
    """Arrays of words, one for each sentence, or for each paragraph.

    Every break ends a sentence, even an empty one; only an empty last one is dropped.
    A null text gives null.
    """
    marked = F.regexp_replace(text, SENTENCE_END, f" {MARK} ")
    parts = F.split(marked, PARAGRAPH_BREAK if paragraphs else MARK)
    return let(F.transform(parts, words), lambda found: F.when(F.size(F.element_at(found, -1)) == 0, F.slice(found, 1, F.size(found) - 1)).otherwise(found))


def name(term: Column) -> Column:
    """A term's words joined by blanks."""
    return F.array_join(term, " ")


def lower(term: Column) -> Column:
    """A term in lower case, word by word."""
    return F.transform(term, F.lower)


def is_open(word: Column) -> Column:
    """Part-of-speech gate: whether a word is outside the closed classes."""
    return ~F.lower(word).isin(*DENIED)


def allowed(terms: Column) -> Column:
    """The gate for each word of a term."""
    return F.transform(terms, is_open)
