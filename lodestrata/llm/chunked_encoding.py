"""Whole-text encoding with the tokenizers library, one distinct chunk at a time.

A byte-level or word BPE never joins a character that is no white space with white
space after it.  So a text may be cut in front of every blank or line feed that
follows such a character, and the ids of the text are the ids of its chunks in
turn.  Chunks that are met often are encoded by the library once and remembered (two
generations of ``MOST`` chunks at most; others are encoded again where they stand).
Texts with other white space than single blanks and line feeds between words, or with
the name of a special token, go to the library uncut.
"""

from __future__ import annotations

import os
import re
from array import array

from lodestrata.llm.common import Recent, held

#: Chunks in one of a worker's two generations, of about 200 bytes each.
MOST = 200_000


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: bytes that are printable stand for themselves, the others follow from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks(Recent):
    """Ids of chunks; a chunk that isn't remembered is encoded by the library.

    The key ``word`` stands for a blank and the word, ``\\nword`` for a line feed
    and the word, ``\\0word`` for a word at the start of a text.
    """

    def __init__(self, tok):
        super().__init__(MOST)
        self.tok, self.tokenize, self.letters = tok, tok.model.tokenize, byte_letters()
        # a vocabulary that drops white space and lower-cases has no ids for a blank
        self.lower = not tok.encode(" ", add_special_tokens=False).ids
        self.blank = "" if self.lower else self.letters[32]
        self.stops = {x: self.library(x) for n in range(1, 4) for x in ("." * n, "," * n)}
        self.feed = self.library("\n")

    def library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, word: str, before: str) -> bytes:
        """A word of plain letters is one pre-token; the library's model gives its ids."""
        if not word.isascii():
            word = word.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(before + word)]).tobytes()

    def make(self, key: str) -> bytes:
        first = key[0]
        word = key[1:] if first == "\n" or first == "\0" else key
        stop = b""
        core = word.rstrip(".,")
        if len(core) < len(word):
            stop = self.stops.get(word[len(core) :])
        if stop is None or not core.isalpha() or not (core.isascii() or max(core) <= "ÿ"):
            text = word if first == "\0" else key if first == "\n" else " " + word
            got = self.library(text)
        elif self.lower:
            low = core.lower()
            got = (self.piece(low, "") if low == key else self[low]) + stop
        elif first == "\n":
            got = self.feed + self.piece(core, "") + stop
        elif first == "\0":
            got = self.piece(core, "") + stop
        else:
            got = (self[core] if stop else self.piece(core, self.blank)) + stop
        return got


class ChunkEncoder:
    """Little-endian uint32 ids of texts, as tokenizers' encode without special tokens gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        names = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.names = re.compile("|".join(map(re.escape, names)) or "(?!)")
        self.chunks = Chunks(self.tok)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text; null is empty."""
        ids, out = self.chunks.__getitem__, []
        for t in texts:
            words = t.split() if t else []
            if not words or "\0" in t or " ".join(words) != t.replace("\n", " ") or self.names.search(t):
                out.append(self.chunks.library(t) if t else b"")  # other white space than single blanks and line feeds, or a special name
                continue
            if not self.chunks.lower:
                words = t.replace("\n", " \n").split(" ")
                words[0] = "\0" + words[0]
            out.append(b"".join(map(ids, words)))
        return out


def encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder for a vocabulary file."""
    return held(path, lambda: ChunkEncoder(path))
