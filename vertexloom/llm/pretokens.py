"""Splitting text into the pieces that byte-pair merges work on.

The usual patterns need Unicode classes. Texts that hold only characters of PLAIN go through the standard `re` with the classes
spelt out, which is faster; what is outside PLAIN goes another way that each operator names.
"""

from __future__ import annotations

import re

import regex

#: Letters, numbers and white space among the characters up to U+024F.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r\x0b\x0c\x85\xa0"
#: Finds a character whose class or normal form this module doesn't spell out (U+0130 grows in lower case).
UNPLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-įı-ɏ‐-‧‰-⁞€]").search

_GPT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+").findall


def splitter(pattern: str):
    """A function that gives the matches of pattern (public_tokenizers.PATTERN, or one of its kind) in a text."""
    full = regex.compile(pattern).findall
    import public_tokenizers

    if pattern != public_tokenizers.PATTERN:
        return full
    return lambda text: full(text) if UNPLAIN(text) else _GPT(text)


def word_pieces(text: str) -> list[str] | None:
    """The pieces of a lower-cased word-BPE text; None if it holds characters outside PLAIN."""
    return None if UNPLAIN(text) else _WORDS(text.lower())
