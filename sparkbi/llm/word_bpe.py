"""Fast exact ids of a BPE vocabulary with word ends, as its JSON file for ``tokenizers`` defines them.

Words repeat, so the ids of a word are kept as packed bytes and a text is a join of lookups.
A new word goes through a byte-pair table: the word end is one extra byte that no UTF-8 text
holds, and a merge's id orders the merges. Texts outside the plainly handled characters go
through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import tiktoken
from tokenizers import Tokenizer

from sparkbi.llm.common import ship_by_value

WORD_END = b"\xff"
MOST_WORDS = 400_000  # words whose ids are kept at a time; the store is emptied beyond
#: Latin, Greek and Cyrillic letters, ASCII, and common punctuation: here Python's character
#: classes and lower case agree with the tokenizer's. Superscripts and fractions, capital sigma
#: and the dotted capital I are left out.
UNUSUAL = re.compile("[^\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏΑ-ΡΤ-Ωά-ώЀ-ҁҊ-ԯ‐-―‘-‟†-•…€]")
#: The splitting rule of the vocabulary file.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + place): byte for place, byte in enumerate(hidden)}


class WordBpe(dict):
    """Maps white-space separated chunks of lower-cased text to packed little-endian ids."""

    def __init__(self, path: str):
        super().__init__()
        self.reference = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            definition = json.load(file)
        self.special = [token["content"] for token in definition["added_tokens"]]
        suffix, byte_of, ranks = definition["model"]["end_of_word_suffix"], _byte_of(), {}
        for token, number in definition["model"]["vocab"].items():
            if token not in self.special:
                ends = token.endswith(suffix)
                ranks[bytes(byte_of[c] for c in token.removesuffix(suffix)) + WORD_END * ends] = number
        table = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.merge = table._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        ids = [number for piece in PIECE.findall(chunk) for number in self.merge(piece.encode() + WORD_END)]
        packed = b"".join([number.to_bytes(4, "little") for number in ids])
        self[chunk] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers, without special tokens added."""
        if UNUSUAL.search(text) or any(token in text for token in self.special) or not unicodedata.is_normalized("NFC", text):
            ids = self.reference.encode(text, add_special_tokens=False).ids
            return b"".join([number.to_bytes(4, "little") for number in ids])
        if len(self) > MOST_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


ship_by_value(__name__)
