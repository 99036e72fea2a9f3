"""Encoding of many texts with a byte-level BPE file of the tokenizers library.

A byte-level BPE never merges across the pieces that its split pattern makes, so
the ids of a text are the ids of its pieces in turn. Pieces repeat; each worker
encodes a piece with the library once and keeps the ids. Texts with characters
beyond the ranges below, where versions of Unicode could disagree about letters
or spaces, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: Tab, line feed, carriage return, printable ASCII, Latin letters, general punctuation without its spaces: any other character.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞]")
#: Letters, digits and spaces among those.
L, N, S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t\n\r"
#: The split pattern of the byte-level pre-tokenizer for such texts.
PIECE = re.compile(rf" ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")


def byte_letters() -> dict[int, int]:
    """The letter that spells each byte in a byte-level vocabulary: itself if it is printable, else the next beyond 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class Encoder:
    """ids and byte lengths of texts under one tokenizer file.

    special: whether strings of special tokens within a text become those tokens, as the library
    does by default; otherwise they are ordinary text.

    kept: pieces of a generation. A worker remembers the ids of the pieces that it met since
    the generation before the last began (about 250 bytes each), so frequent ones stay.
    """

    def __init__(self, path: str, kept: int = 250_000, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        #: strings that are tokens of their own; texts with one go to the library whole
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.tokenizer.no_truncation()
        self.one, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = kept
        self.size = self.tokenizer.get_vocab_size()
        form = json.loads(self.tokenizer.to_str())
        split = form.get("pre_tokenizer") or {}
        #: whether the file is a byte-level BPE as described above; texts under others go to the library whole
        self.by_bytes = not form.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers; null or empty: none."""
        if not text:
            return b""
        if not self.by_bytes or OTHER.search(text) or self.added and self.added.search(text):
            return self.whole(text)
        pieces = PIECE.findall(text)
        if len(self.memory) > self.kept:
            self.older, self.memory = self.memory, {}
        memory, older = self.memory, self.older
        for piece in set(pieces).difference(memory):
            found = older.get(piece)
            if found is None:
                spelt = piece if piece.isascii() else piece.encode().decode("latin-1")
                ids = [t.id for t in self.one(spelt.translate(self.letters))]
                found = pack(f"<{len(ids)}I", *ids)
            memory[piece] = found
        return b"".join(map(memory.__getitem__, pieces))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype="<u4")

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token; tokens that are parts of one character span it all."""
        if not text:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not self.by_bytes:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
            return found[:, 0], found[:, 1]
        ends = self.byte_lengths[self.ids(text)].cumsum()
        starts = np.concatenate([[0], ends[:-1]])
        if text.isascii():
            return starts, ends
        character = ((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80).cumsum() - 1
        return character[starts], character[ends - 1] + 1

    @property
    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id stands for; a token is spelled with one letter a byte."""
        if not hasattr(self, "_lengths"):
            lengths = np.zeros(self.size, dtype=np.int64)
            for token, number in self.tokenizer.get_vocab().items():
                lengths[number] = len(token)
            self._lengths = lengths
        return self._lengths


    def text(self, ids: np.ndarray) -> str:
        """The text that ids spell, whole characters being given."""
        if not self.by_bytes:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        if not hasattr(self, "_bytes"):
            back = {chr(letter): byte for byte, letter in self.letters.items()}
            self._bytes = [b""] * self.size
            for token, number in self.tokenizer.get_vocab().items():
                self._bytes[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return b"".join(map(self._bytes.__getitem__, ids.tolist())).decode()


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> Encoder:
    """One encoder for each file, treatment of special tokens and worker process."""
    return Encoder(path, special=special)
