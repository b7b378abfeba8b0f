"""Token ids of whole texts by the ``tokenizers`` library, a word at a time.

The tokenizer never joins or compares anything across ASCII white space (its
pattern's matches hold none and white space itself is dropped), so a text's ids
are the ids of its words in order; and a word's ids are those of the pieces that
the pattern finds in its lower-cased form. Words and pieces repeat, so a bounded
memory of both saves most of the work; it never changes a result. Words with
characters beyond U+024F, or with a special token's bracket, go to the library
whole.
"""

from __future__ import annotations

import unicodedata
from array import array

import regex

from countershift.llm.text import blocks

#: Words, and pieces, remembered by one Python worker (about 200 bytes each), and the longest of them.
MEMORY_WORDS, MEMORY_PIECES = 250_000, 250_000
MEMORY_BYTES = 48

# The tokenizer's pattern, for ASCII and for characters up to U+024F (whose classes no version of Unicode changes).
ASCII_PIECES = regex.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
LATIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t\n\x0b\x0c\r \x85\xa0\p{L}\p{N}]+")
LATIN = regex.compile(r"[\x00-\u024F]*")

_encoders: dict[str, WordEncoder] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    return [chr(rest.get(b, b)) for b in range(256)]


def pieces_of(word: bytes) -> list[bytes] | None:
    """The pattern's pieces of a word, normalised; None where only the library should divide it."""
    if word.isascii():
        # letters alone, or before one other character, need no pattern
        if word.isalpha():
            return [word.lower()]
        if word[:-1].isalpha():
            return [word[:-1].lower(), word[-1:]]
        return ASCII_PIECES.findall(word.lower())
    text = word.decode()
    if LATIN.fullmatch(text):
        lower = unicodedata.normalize("NFC", text).lower()
        return [lower.encode()] if lower.isalpha() else [p.encode() for p in LATIN_PIECES.findall(lower)]
    return None


class WordEncoder:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.table = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def ids(self, data: bytes) -> bytes:
        return b"".join([self._block(block) for block in blocks(data)])

    def _block(self, data: bytes) -> bytes:
        words = data.split()
        known = self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) > MEMORY_WORDS:
                known.clear()
                missing = set(words)
            self._learn(missing)
            out = b"".join([known[w] for w in words])
            for w in missing:
                if len(w) > MEMORY_BYTES:
                    del known[w]
            return out
        return b"".join([known[w] for w in words])

    def _learn(self, words: set[bytes]) -> None:
        divided = [(w, None if b"<|" in w else pieces_of(w)) for w in words]
        pieces = self.pieces
        if len(pieces) > MEMORY_PIECES:
            pieces.clear()
        new = {p for _, ps in divided if ps for p in ps}.difference(pieces)
        tokenize, table = self.model.tokenize, self.table
        for p in new:
            # pieces are normalised and divided already: the library's merges are all that is left
            pieces[p] = array("I", [t.id for t in tokenize(p.decode("latin-1").translate(table))]).tobytes()
        whole = [w for w, ps in divided if ps is None]
        self.known.update(zip(whole, self._encode(whole)))
        for w, ps in divided:
            if ps is not None:
                self.known[w] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
        for p in new:
            if len(p) > MEMORY_BYTES:
                del pieces[p]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids from one call of the library."""
        if not words:
            return []
        encoding = self.tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        found: list[list[int]] = [[] for _ in words]
        for token, word in zip(encoding.ids, encoding.word_ids):
            found[word].append(token)
        return [array("I", ids).tobytes() for ids in found]


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
