"""Byte-level BPE files and the pre-token split shared by packing and token counts."""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

BPE_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: Entries of a per-worker memory of words; it is emptied when full.
MEMORY = 500_000

@lru_cache(maxsize=2)
def ranks(file: str = RANKS_FILE) -> dict[bytes, int]:
    with open(public_tokenizers.path(file), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def bpe(file: str = RANKS_FILE) -> tiktoken.Encoding:
    """The same vocabulary and merges as BPE_FILE, in the library that is quicker on short strings."""
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(file), special_tokens={})


@lru_cache(maxsize=2)
def full_tokenizer(file: str = BPE_FILE) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(file))


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def stands_alone(word: str) -> bool:
    """Whether " " + word can be pre-tokenised apart from its neighbours: a space between
    two characters that aren't white space always begins a pre-token."""
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def split_words(text: str) -> tuple[str, list[str]] | None:
    """(first word, further words, each to be read with a space before it) of a text
    whose spaces all stand alone; None for any other text."""
    first, *rest = text.split(" ")
    if first[-1:].isspace() or not all(map(stands_alone, rest)):
        return None
    return first, rest
