"""Text primitives that agree with Unicode-aware str methods on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.split() and str.strip() treat as white space.
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SPACE = r"[\s\x1c-\x1f]"  # under (?U), which makes \s cover the rest of SPACE_CHARS
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    """White-space tokens in order, none of them empty."""
    return F.filter(F.split(text, "(?U)" + SPACE + "+"), lambda t: t != "")


def clean_token(token: Column) -> Column:
    return F.regexp_replace(token, NOT_WORD, "")


def spaced(text: Column) -> Column:
    """Stripped text with every run of white space as one blank."""
    return F.regexp_replace(strip(text), "(?U)" + SPACE + "+", " ")


def clean_tokens(spaced_text: Column) -> Column:
    """``clean_token`` of all tokens of a spaced text, by one pass over the whole text.

    A token of punctuation alone stays as an empty entry, so positions line up with
    the tokens themselves.
    """
    return F.split(F.regexp_replace(spaced_text, r"[^\p{L}\p{N}_ ]", ""), " ")


def word_set(text: Column) -> Column:
    return F.split(text, NOT_WORD + "+")


def between(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing`` character, or NULL.

    Same result as a greedy ``opening.*closing`` search, in linear time.
    """
    start = F.locate(opening, text)
    end = F.char_length(text) + 1 - F.locate(closing, F.reverse(text))
    found = (start > 0) & F.contains(text, F.lit(closing)) & (end > start)
    return F.when(found, F.substring(text, start, end - start + 1))


def vocabulary(spaced_text: Column) -> Column:
    """The distinct tokens of a text, blank-separated: a shorter text with the same words."""
    return F.array_join(F.array_distinct(F.split(spaced_text, " ")), " ")
