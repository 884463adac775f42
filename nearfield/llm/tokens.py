"""Whole-text tokenization with a public tokenizer file, sped up by a cache of words.

The tokenizer splits a text into words and encodes each by itself.  For texts of plain letters, digits and
signs the split is done here and only words not yet in the cache go to the library's model; any other text
goes to the library whole.  The ids are the library's either way.  The library's own threads stay off: tasks
are the parallelism, and for a few words at a time its threads cost more than the words.

The split made here is that of one kind of tokenizer file.  A file with another normalizer, pre-tokenizer, model or
other special tokens is recognised when it is loaded, and all texts go to the library whole.

Edge cases: an empty text has no ids; callers turn null into the empty text; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np

#: Appended to each document.
END_ID = 1
#: Characters for which lower case, normalization and the split are the same here as in the library: as bytes
#: (ASCII but for control characters, and U+00C0 to U+00FF), and in full.
PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), 0xC3, *range(0x80, 0xC0)])
UNSAFE = re.compile("[^\t\n\r\x20-\x7eÀ-ÿ‐-‧]")
WORD = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
#: The steps of the tokenizer files whose split is made here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Words in the cache of one worker: under 300 MB.
CACHE_WORDS = 1_000_000


def is_plain(text: str) -> bool:
    """Whether the text can be split here: no characters but those above, and nothing like a special token."""
    return "<|" not in text and (not text.encode("utf-8", "surrogatepass").translate(None, PLAIN) or not UNSAFE.search(text))


def splits_by_words(whole) -> bool:
    """Whether this module's split and lower-casing are those of the tokenizer."""
    steps = json.loads(whole.to_str())
    model = steps["model"]
    return (
        steps["normalizer"] == NORMALIZER
        and steps["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        and model["type"] == "BPE"
        and not model.get("dropout")
        and all(token["content"].startswith("<|") for token in steps["added_tokens"])
    )


class Words(dict):
    """The ids of words as bytes (unsigned 32-bit integers), encoded at their first use."""

    def __init__(self, whole):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenize = whole.model.tokenize
        # The model takes bytes as the printable characters that the byte-level step puts in their place.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xA1, 0x100), *range(0x2010, 0x2028))}

    def __missing__(self, word: str) -> bytes:
        piece = word if word.isascii() else word.translate(self.as_bytes)
        found = self[word] = array("I", [token.id for token in self.tokenize(piece)]).tobytes()
        return found


class WordTokenizer:
    """Ids of whole texts by the tokenizer in `path`."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.known = Words(self.whole) if splits_by_words(self.whole) else None

    def ids(self, text: str) -> np.ndarray:
        """The ids of `text` without special tokens, as unsigned 32-bit integers."""
        if self.known is None or not is_plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        parts = []
        for begin, end in cuts(text):
            parts.append(b"".join(map(self.known.__getitem__, WORD.findall(text[begin:end].lower()))))
            if len(self.known) > self.cache_words:
                self.known.clear()
        return np.frombuffer(b"".join(parts), dtype=np.uint32)


def cuts(text: str, size: int = 1 << 20) -> list[tuple[int, int]]:
    """The text in chunks that end at white space."""
    found, begin = [], 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and not text[end].isspace():
            end += 1
        found.append((begin, end))
        begin = end
    return [*found, (begin, len(text))]


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)
