"""Ids of whole texts by a tokenizer file, with one library call per distinct word.

White space ends every word and is dropped by these tokenizers, so a text's ids are the ids of its
words in order. Strings of the file's special tokens are cut out first and have their own ids, as the
library gives them. Words already met in this worker are looked up; once the table holds ``limit`` words
it becomes the older one, from which words that are met again are taken back, and the one before
goes. This bounds memory and changes no result.
"""

from __future__ import annotations

import json
import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
#: Each a piece of its own after letters.
MARKS = frozenset(".,")
#: White space as the tokenizers library's patterns have it; Python's set differs.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    return public_tokenizers.path(WORD_BPE)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class _Words(dict):
    """Word (bytes without ASCII white space) to its ids (unsigned 32-bit little-endian)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[str, bytes]] = {}, {}
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = (
            [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["invert"]
            and steps[0]["behavior"] == "Removed"
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
        )
        #: Splits a normalised word as the file says; None: the library does the whole word.
        self.split = None
        if plain:
            pattern = steps[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
            self.split = regex.compile(pattern).findall
            assert r"\s" not in pattern
        self.special = {t["content"].encode(): t["id"].to_bytes(4, "little") for t in spec["added_tokens"] if not t["normalized"]}
        longest = sorted(self.special, key=len, reverse=True)
        #: Splits a text at its special tokens, which are kept.
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")").split if longest else None
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def turn(self) -> None:
        self.older = dict(self), self.pieces
        self.clear()
        self.pieces = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.older[0].get(word)
        if found is not None:
            self[word] = found
            return found
        text = word.decode("utf-8", "replace")
        if self.split is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = b"".join(i.to_bytes(4, "little") for i in ids)
        else:
            # below U+0250 the library's normaliser only makes letters small
            small = text and (text.isascii() or max(text) < "\u0250")
            text = text.lower() if small else self.tokenizer.normalizer.normalize_str(text)
            if text.isalpha():
                found = self.pieces.get(text) or self.piece(text)
            elif text[-1:] in MARKS and text[:-1].isalpha():
                head, mark = text[:-1], text[-1]
                found = (self.pieces.get(head) or self.piece(head)) + (self.pieces.get(mark) or self.piece(mark))
            else:
                found = b"".join(map(self.piece, self.split(text)))
        self[word] = found
        return found

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text) or self.older[1].get(text)
        if found is None:
            plain = text.isascii() and text.isprintable() and " " not in text
            mapped = text if plain else "".join(map(self.letters.__getitem__, text.encode()))
            coded = self.coded
            found = b"".join([coded[t.id] for t in self.model.tokenize(mapped)])
        self.pieces[text] = found
        return found


class Encoder:
    """``ids(text)``: the text's ids as unsigned 32-bit little-endian bytes, with the end id."""

    def __init__(self, path: str, end_id: int = END_ID, limit: int = 600_000):
        self.path, self.limit = path, limit
        self.end = end_id.to_bytes(4, "little")
        self.words = _Words(path)
        #: Whether 16 bits hold every id.
        self.narrow = max(self.words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16

    def ids(self, text: bytes | None) -> bytes:
        words, text = self.words, text or b""
        if len(words) > self.limit:
            words.turn()
        if words.cut is not None and b"<" in text:
            parts = words.cut(text)
            if len(parts) > 1:
                found = [words.special.get(part) or b"".join(map(words.__getitem__, part.split())) for part in parts]
                return b"".join(found) + self.end
        return b"".join(map(words.__getitem__, text.split())) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """This worker's encoder; later tasks of the worker find the words of earlier ones."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
