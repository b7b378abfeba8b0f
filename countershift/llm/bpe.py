"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoder. The trie of all tokens gives the longest token that starts at a position
of a word, and each token leads to the next shorter one that starts like it. The
longest is tried first; it is accepted if the position behind it isn't known to be a dead end and if it may
stand behind the previous token. Two tokens may stand side by side exactly if
merging their joint text gives these two again, which the table of merges
answers by undoing merges from the inside (:meth:`Vocabulary.compatible`). A
position without an acceptable token is marked dead and the previous token
shortened. Every position dies once at most, so a word takes linear time, and
the result is that of applying the merges in order of rank.

Decoder. All tokens lie in one buffer with a table of offsets; ids become text
by one gather for a block of ids.

Defined results: null text counts as empty and has no tokens; equal rows have
equal results; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from countershift.llm.text import blocks
from countershift.llm.tokens import byte_characters, pieces_of

END = "</w>"
#: Words and letter groups remembered by one Python worker, and the longest of them in bytes.
MEMORY_WORDS = 300_000
MEMORY_BYTES = 48
#: Places of a long word whose tokens were listed at a time; nothing is listed any more, and no result depends on it (tests set it).
WINDOW = 1 << 16
#: Ids decoded at once.
DECODE_BLOCK = 1 << 18


class Vocabulary:
    """Tokens, merges and special strings of a word-ending BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.text = {i: t for t, i in (ids | self.special).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        # inside, a symbol is one character: a byte, or a byte that ends a word (512 of them)
        self.first = {}
        chars = byte_characters()
        symbol: dict[int, str] = {}
        for b, c in enumerate(chars):
            self.first[b], self.first[256 + b] = ids[c], ids[c + END]
            symbol[ids[c]], symbol[ids[c + END]] = chr(b), chr(256 + b)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {i: (i, i) for i in symbol}
        self.rank: dict[int, int] = {i: -1 for i in symbol}
        for rank, (a, b) in enumerate(merges):
            token = ids[a + b]
            self.merged.setdefault((ids[a], ids[b]), token)
            if token not in symbol:
                symbol[token], self.parts[token], self.rank[token] = symbol[ids[a]] + symbol[ids[b]], (ids[a], ids[b]), rank
        self.length = {i: len(s) for i, s in symbol.items()}
        # a token that merging its own text would not give is never produced
        self.tokens = {symbol[t]: t for t, (a, b) in self.parts.items() if a == t or self.compatible(a, b, self.rank[t])}
        # the tokens' trie: a node's characters lead on, "" has the longest token that the way to the node begins with
        self.root: dict = {}
        for text, token in sorted(self.tokens.items(), key=lambda x: len(x[0])):
            node = self.root
            for c in text:
                node = node.setdefault(c, {"": node.get("")})
            node[""] = token
        self.longest = max(map(len, self.tokens))
        #: Of each token the longest one that its text begins with.
        self.shorter = {t: next((self.tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.tokens), None) for s, t in self.tokens.items()}
        self._pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether no merge of rank below ``limit`` would join across this border before both tokens are whole.

        The symbols that touch at the border are the last part of the left and
        the first part of the right token at some moment of merging. Undoing the
        later of the two tokens' last merges goes back in time; a merge known for
        the pair at hand that ranks before the one just undone would have come first.
        """
        rank, merged, parts = self.rank, self.merged, self.parts
        limit = len(self.merged) + 1 if limit is None else limit
        while True:
            joint = merged.get((left, right))
            if joint is not None and rank[joint] < limit:
                return False
            # which of the two was made later (ties: the left merge of equal rank comes first, so undo the right)
            if rank[left] > rank[right]:
                limit, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def joinable(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            found = self._pairs[key] = self.compatible(left, right)
        return found

    def encode_symbols(self, symbols: str) -> array:
        """Ids of one word given as symbols (characters 0-255: bytes; 256-511: the last byte).

        Only places that a token ends at are looked at, and a token's shorter
        ones are listed once for the vocabulary, so that a word of any length
        takes a few bytes a character.
        """
        token = self.tokens.get(symbols)
        if token is not None:  # nothing is longer, and nothing stands beside it
            return array("I", (token,))
        size, longest, root, length, shorter, known = len(symbols), self.longest, self.root, self.length, self.shorter, self._pairs.get
        alive = bytearray(b"\x01") * (size + 1)
        out = array("I")
        at, last, token = 0, None, None
        while at < size:
            if token is None:  # the longest that starts here; single symbols are tokens
                node = root
                for c in symbols[at : at + longest]:
                    if c not in node:
                        break
                    node = node[c]
                token = node[""]
            while token is not None:
                end = at + length[token]
                if alive[end]:
                    fits = last is None or known((last, token))
                    if fits is None:
                        fits = self.joinable(last, token)
                    if fits:
                        break
                token = shorter[token]
            else:  # nothing may stand here: the token before becomes a shorter one, if it has one
                while token is None:
                    alive[at] = 0
                    before = out.pop()
                    at -= length[before]
                    last, token = out[-1] if out else None, shorter[before]
                continue
            out.append(token)
            at, last, token = end, token, None
        return out


class Codec:
    """Encodes and decodes whole texts; one for each file and Python worker."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        own = Tokenizer.from_file(path)
        self.normalizer, self.divide = own.normalizer, own.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.marked = regex.compile(b"|".join(regex.escape(s.encode()) for s in v.special)).search if v.special else lambda word: None
        size = max(v.text) + 1
        texts = [v.text.get(i, "").encode() + b" " for i in range(size)]
        self.tokens = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        digits = [b"%d " % i for i in range(size)]
        self.decimals = np.frombuffer(b"".join(digits), np.uint8), np.cumsum([0, *map(len, digits)])

    def encode(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text's UTF-8 bytes."""
        return b"".join([self._block(block) for block in blocks(data)])

    def _block(self, data: bytes) -> bytes:
        known, words = self.words, data.split()
        missing = set(words).difference(known)
        long = []
        if missing:
            if len(known) > MEMORY_WORDS:
                known.clear()
                missing = set(words)
            for w in missing:
                known[w] = self._word(w)
                if len(w) > MEMORY_BYTES:
                    long.append(w)
        out = b"".join([known[w] for w in words])
        for w in long:
            del known[w]
        return out

    def _word(self, word: bytes) -> bytes:
        if self.marked(word):
            text, out, at = word.decode(), [], 0
            for m in self.special.finditer(text):
                out += [self._plain(text[at : m.start()].encode()), array("I", [self.vocabulary.special[m[0]]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:].encode())])
        return self._plain(word)

    def _plain(self, word: bytes) -> bytes:
        found = pieces_of(word)
        if found is None:  # the library's own division into pieces: classes of rare characters depend on the version of Unicode
            cut = self.divide.pre_tokenize_str(self.normalizer.normalize_str(word.decode()))
            found = [bytes(map(self.byte_of.__getitem__, p)) for p, _ in cut]
        pieces = self.pieces
        out = []
        for p in found:
            ids = pieces.get(p)
            if ids is None:
                ids = self.vocabulary.encode_symbols(p[:-1].decode("latin-1") + chr(256 + p[-1])).tobytes()
                if len(p) <= MEMORY_BYTES:
                    if len(pieces) > MEMORY_WORDS:
                        pieces.clear()
                    pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    @staticmethod
    def _gather(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
        buffer, offsets = table
        first = offsets[ids]
        lengths = offsets[ids + 1] - first
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - lengths), lengths)
        return buffer[at].tobytes()

    def joined(self, ids: bytes, table: tuple[np.ndarray, np.ndarray]):
        """Blocks of the ids' entries in a table, joined by one space, none at the end."""
        numbers = np.frombuffer(ids, np.uint32).astype(np.intp)
        for at in range(0, len(numbers), DECODE_BLOCK):
            block = self._gather(numbers[at : at + DECODE_BLOCK], table)
            yield block if at + DECODE_BLOCK < len(numbers) else block[:-1]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.joined(ids, self.tokens)).decode()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also ``ids`` and ``decoded``. No shuffle."""

    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = c.encode(text.as_py() or b"")
                numbers, decoded = hashlib.sha256(), hashlib.sha256()
                for part in c.joined(ids, c.decimals):
                    numbers.update(part)
                for part in c.joined(ids, c.tokens):
                    decoded.update(part)
                row = (doc_id, len(ids) // 4, numbers.hexdigest(), decoded.hexdigest())
                rows.append((*row, np.frombuffer(ids, np.uint32).astype(np.int32), c.decode(ids)) if texts else row)
                if texts and len(rows) >= 256:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * texts)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
