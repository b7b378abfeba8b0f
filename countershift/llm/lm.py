"""Hierarchical Pitman-Yor language model: training by Gibbs-sampled seating, and scores of whole texts.

Model. A token's context is the word before it (the empty word opens a text).
Each distinct context is a restaurant; all of them share one parent restaurant
over words, whose base is uniform over the training words and one unknown word.
Customers of a context restaurant are training tokens; each of its tables sends
one customer to the parent. The sampler draws how many tables serve each
(context, word): up to ``EXACT`` customers from the exact conditional
(generalised Stirling numbers by recursion), beyond from the same weights by
expansions that tests hold against the recursion. After the first sweeps the restaurants' totals are refreshed
from all words; then predictive probabilities are averaged over further sweeps,
and their log10 summed over a text.

Execution. One pass turns documents into blocks: for each block and each of
``n_parts`` ranges of word hashes one compact row with (word, context) pairs and
document numbers. One shuffle by range writes them to a bucketed table in the
shared folder, where every later pass finds a range's rows together. What a range needs of others are totals by context: it sends its
own to the range of the context's hash, where they are added, and gets the sums
back for the contexts it holds. Nothing that grows with the corpus passes
through the driver.

Words with over a thousandth of a sample's tokens, and the end token, are *hot*:
at most ``MAX_HOT``. The sample is drawn by the rows' hashes, so neither the
number nor the order of the input's partitions changes a score. Their pairs are spread over all ranges, and their customers
at the parent are totals that every range gets. Hot pairs (at most ``MAX_HOT``)
are counted before they leave a task. Which words and pairs are hot changes the
place of work, not the counts.

Words are told apart by 64-bit hashes. Defined results: null text counts as
empty (the end token alone); a null id counts as the empty string for the folds
and is kept; equal rows are scored each; without training rows every known count
is zero; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.langid import fold
from countershift.llm.shared import bucketed, drop, materialize
from countershift.llm.text import blocks, release_memory

#: Contexts of a :class:`Seating` unless it is given their number.
CONTEXTS = 64
MAX_HOT = 1000
#: Files of the table of ranges; beyond, a file holds several ranges.
MAX_BUCKETS = 50_000
#: Slices of the documents (by their ids' hashes) that are shuffled one after the other.
SLICES = 4
#: Tokens and documents that close a block, and tokens of a range of words, which is what a task holds in arrays at a time.
BLOCK_TOKENS, BLOCK_DOCS, PART_TOKENS = 2_000_000, 60_000, 3_000_000
#: One document of so many, chosen by the hash of its id and text, tells the hot words and the number of ranges.
SAMPLED = 50
#: Customers of one dish up to which the Stirling numbers come from their recursion.
EXACT = 1000
CONCENTRATION = 1.0
SMOOTHING = 0.1
#: The end token as a word, and the opening of a text as a context.
_EDGE = b""


class _Numbers(dict):
    """Words by order of appearance."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _hash(words) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _pair_hash(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (words ^ (contexts << np.uint64(31)) ^ (contexts >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in a sorted array, -1 where they are not."""
    if not len(sorted_):
        return np.full(len(values), -1)
    near = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[near] == values, near, -1)


class Hot:
    """Hot words and hot pairs by their hashes."""

    def __init__(self, words: np.ndarray, pairs: list[tuple[int, int]]):
        self.words = np.unique(np.concatenate([words, np.array([w for w, _ in pairs], np.uint64), _hash([_EDGE])]))
        own = np.array(pairs, np.uint64).reshape(-1, 2)
        hashes = _pair_hash(own[:, 0], own[:, 1])
        order = np.argsort(hashes)
        self.pairs, self.pair_word, self.pair_context = hashes[order], own[order, 0], own[order, 1]


# ---- one pass over the documents -------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed payload, equal bytes of their numbers together."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays)
    return struct.pack(f"<{len(arrays) + 1}I", len(raw), *map(len, arrays)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    size, *lengths = struct.unpack_from(f"<{len(kinds) + 1}I", payload)
    raw, at, out = pa.Codec("zstd").decompress(memoryview(payload)[4 * len(kinds) + 4 :], size, asbytes=True), 0, []
    for kind, n in zip(kinds, lengths):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences, which take fewer bytes; ``np.cumsum`` gives them back."""
    return np.diff(hashes, prepend=np.uint64(0))


class _Block:
    def __init__(self, hot: Hot, n_parts: int):
        self.hot, self.n_parts = hot, n_parts
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.edge = self.numbers[_EDGE]
        self.tokens: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.size = 0

    def add(self, doc_id: int | None, held_out: bool, text: bytes) -> None:
        n, get = 0, self.numbers.__getitem__
        for block in blocks(text.lower()):
            words = block.split()
            self.tokens.append(np.fromiter(map(get, words), np.int32, len(words)))
            n += len(words)
        self.tokens.append(np.array([self.edge], np.int32))
        self.lengths.append(n)
        self.ids.append(doc_id)
        self.held.append(held_out)
        self.size += n + 1

    def rows(self, block: int):
        """(part, block, payload): a row per range of words, and one of the documents (part: n_parts + ...)."""
        lengths, held = np.array(self.lengths, np.int64), np.array(self.held, bool)
        hashes = _hash(self.numbers)
        # words are numbered by their hashes from here on
        by = np.argsort(hashes)
        hashes, rank = hashes[by], np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        token = rank[np.concatenate(self.tokens)]
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        # the token before the first one of a text is the end of the text before
        context = np.concatenate(([rank[self.edge]], token[:-1]))
        pairs, kind = np.unique(token * len(hashes) + context, return_inverse=True)
        word, context = np.divmod(pairs, len(hashes))
        pair_hashes = _pair_hash(hashes[word], hashes[context])

        number = _find(self.hot.pairs, pair_hashes)
        warm = (number >= 0)[kind]
        codes = number[kind[warm]].astype(np.uint16)
        per_doc = np.bincount(doc[warm], minlength=len(lengths)).astype(np.uint32)
        known = np.array([i is not None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        payload = struct.pack("<I", len(lengths)) + b"".join(x.tobytes() for x in (ids, known, held, lengths, per_doc, codes))
        yield self.n_parts + block % self.n_parts, block, payload

        is_hot = (_find(self.hot.words, hashes) >= 0)[word]
        part = (np.where(is_hot, pair_hashes, hashes[word]) >> np.uint64(20)) % np.uint64(self.n_parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own = rank[kind[~warm]]
        doc = doc[~warm]
        by = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(order)).astype(np.uint32)
        customers = np.bincount(own[~held[doc]], minlength=len(order)).astype(np.uint32)
        doc = doc[by].astype(np.uint16)
        token_at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        word, context, part = word[order], context[order], part[order]
        cuts = np.searchsorted(part, np.arange(self.n_parts + 1))
        for p in range(self.n_parts):
            a, b = cuts[p : p + 2]
            if token_at[a] == token_at[b]:
                continue
            used = a + np.flatnonzero(counts[a:b])
            words, w = np.unique(word[used], return_inverse=True)
            contexts, c = np.unique(context[used], return_inverse=True)
            # pairs are sorted by word, most stand once, and most of them in training
            yield p, block, _pack(_steps(hashes[words]), _steps(hashes[contexts]), np.diff(w, prepend=0).astype(np.uint32), c.astype(np.uint32), counts[used], counts[used] - customers[used], doc[token_at[a] : token_at[b]])


def _blocked(rows: DataFrame, hot: Hot, n_parts: int, k: int) -> DataFrame:
    """Blocks of the rows, which are slice ``k`` of all: part, block, payload."""

    def run(batches):
        now, number = _Block(hot, n_parts), (k << 48) + (TaskContext.get().partitionId() << 24)
        for batch in batches:
            for doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                now.add(doc_id, held_out, text.as_py() or b"")
                if now.size >= BLOCK_TOKENS or len(now.ids) >= BLOCK_DOCS:
                    yield _payloads(now.rows(number))
                    now.clear()
                    release_memory()
                    number += 1
        if now.ids:
            yield _payloads(now.rows(number))
        now.clear()
        release_memory()

    return rows.mapInArrow(run, "part int, block long, payload binary")


def _payloads(rows) -> pa.RecordBatch:
    parts, numbers, payloads = zip(*rows)
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(numbers, pa.int64()), pa.array(payloads, pa.binary())], names=["part", "block", "payload"])


def _hot_words(rows: DataFrame) -> tuple[Hot, float]:
    """Frequent words and pairs of a sample, and the sample's tokens. Only a decision about where work is done.

    The sample and its partitions follow from the rows' hashes, so that the same
    rows give the same decision however they are laid out. Words are counted
    first. A pair is never more frequent than either of its words, so pairs are
    counted of hot words alone, and nothing that could be hot is left out.
    """

    def counted(hot: set[int] | None):
        """Counts of words (word, n) where ``hot`` is None, else of pairs of these words (word, context, n); by batch."""

        def run(batches):
            for batch in batches:
                counts: dict = {}
                seen: dict[bytes, int | None] = {}

                def number(w: bytes) -> int | None:
                    """The hash of a hot word as a signed long."""
                    if w not in seen:
                        h = int(_hash([w]).view(np.int64)[0])
                        seen[w] = h if h in hot else None
                    return seen[w]

                for text in batch.column(0).to_pylist():
                    last = hot and number(_EDGE)
                    for block in (*blocks((text or b"").lower()), None):
                        for w in [_EDGE] if block is None else block.split():
                            if hot is None:
                                counts[w] = counts.get(w, 0) + 1
                                continue
                            now = number(w)
                            if now is not None and last is not None:
                                counts[now, last] = counts.get((now, last), 0) + 1
                            last = now
                n = pa.array([*counts.values()], pa.int64())
                if hot is None:
                    yield pa.record_batch([pa.array(_hash(counts).view(np.int64)), n], names=["word", "n"])
                else:
                    yield pa.record_batch([pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.int64()), n], names=["word", "context", "n"])

        return run

    h = F.xxhash64("doc_id", "text")
    sample = materialize(rows.where(F.pmod(h, F.lit(SAMPLED)) == 0).select("text", h.alias("h")), "lm-sample")
    parts = max(8, -(-sample.count() // 2000))
    dealt = sample.repartition(parts, F.hash("h")).select("text")
    found = materialize(dealt.mapInArrow(counted(None), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-frequent")
    total = found.agg(F.sum("n")).first()[0] or 0
    # fewer than MAX_HOT words, and so pairs, have more than a share of 1 / MAX_HOT
    frequent = lambda df, *by: df.where(F.col("n") * MAX_HOT > total).orderBy(F.col("n").desc(), *by).collect()
    hot_words = [r["word"] for r in frequent(found, "word")]
    pairs_found = dealt.mapInArrow(counted({*hot_words}), "word long, context long, n long").groupBy("word", "context").agg(F.sum("n").alias("n"))
    hot_pairs = frequent(pairs_found, "word", "context") if hot_words else []
    unsigned = lambda x: x % (1 << 64)
    words = [unsigned(w) for w in hot_words]
    pairs = [(unsigned(r["word"]), unsigned(r["context"])) for r in hot_pairs]
    drop(sample, found)
    return Hot(np.array(words, np.uint64), pairs), float(total)


# ---- one range of words ----------------------------------------------------------------------


class Seating:
    """Customers and tables of a set of words; what other words hold enters by totals.

    ``shared`` names the words (by their place among the hot ones, else -1) whose
    other customers at the parent are elsewhere, see :meth:`surround`.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, customers: np.ndarray, n_words: int, n_contexts: int = CONTEXTS, shared: np.ndarray | None = None):
        self.word, self.context, self.customers, self.n_words, self.n_contexts = word, context.astype(np.intp), customers.astype(np.int64), n_words, n_contexts
        self.shared = np.full(n_words, -1) if shared is None else shared
        self.own = self.shared < 0
        self.outside = np.zeros(n_words, np.int64)
        self.tables = (self.customers > 0).astype(np.int64)
        self.parent = self._parent()
        self.parent_tables = (self.parent > 0).astype(np.int64)

    def _parent(self) -> np.ndarray:
        return np.bincount(self.word, self.tables, self.n_words).astype(np.int64) + self.outside

    def hot(self, n_hot: int) -> np.ndarray:
        """Customers and tables of the shared words."""
        at = np.flatnonzero(~self.own)
        out = np.zeros((2, n_hot))
        for row, x in zip(out, (self.customers, self.tables)):
            row[self.shared[at]] = np.bincount(self.word, x, self.n_words)[at]
        return out

    def surround(self, parent: np.ndarray, parent_tables: np.ndarray) -> None:
        """Take the shared words' customers and tables at the parent, ours as they are now among them."""
        at = np.flatnonzero(~self.own)
        self.outside = np.zeros(self.n_words, np.int64)
        self.outside[at] = parent[self.shared[at]] - self._parent()[at]
        self.parent = self._parent()
        self.parent_tables[at] = parent_tables[self.shared[at]]

    def totals(self) -> np.ndarray:
        """Sums that the other ranges need: customers and tables by context, the parent's tables, words, counts of counts."""
        words = np.bincount(self.word, self.customers, self.n_words)
        ones = [np.count_nonzero(x == k) for x in (self.customers, self.parent[self.own]) for k in (1, 2)]
        by = [np.bincount(self.context, x, self.n_contexts) for x in (self.customers, self.tables)]
        return np.concatenate([*by, [self.parent_tables[self.own].sum(), np.count_nonzero(words[self.own])], ones]).astype(np.float64)

    def sweep(self, all_totals: np.ndarray, own_before: np.ndarray, rng: np.random.Generator, model: Model) -> None:
        """Draw all tables again, given everything else. ``own_before``: these words' part in ``all_totals``."""
        total = all_totals + self.totals() - own_before
        tables = total[self.n_contexts : 2 * self.n_contexts]
        many = np.flatnonzero(self.customers >= 2)
        if len(many):
            w, u, t = self.word[many], self.context[many], self.tables[many]
            others = np.maximum(self.parent[w] - t, 0)
            other_tables = np.minimum(self.parent_tables[w], others)
            p = model.parent_probability(others, other_tables, total)
            self.tables[many] = draw_tables(self.customers[many], np.maximum(tables[u] - t, 0), p, model.discount, rng, t)
        self.parent = self._parent()
        settled = np.minimum(np.maximum(self.parent_tables, self.parent > 0), self.parent)
        self.parent_tables = np.where(self.own, settled, self.parent_tables)
        many = np.flatnonzero((self.parent >= 2) & self.own)
        if len(many):
            t = self.parent_tables[many]
            rest = np.maximum(total[2 * self.n_contexts] - t, 0)
            self.parent_tables[many] = draw_tables(self.parent[many], rest, np.full(len(many), model.base), model.parent_discount, rng, t)

    def probability(self, all_totals: np.ndarray, own_before: np.ndarray, model: Model) -> np.ndarray:
        """Predictive probability of each (word, context)."""
        total = all_totals + self.totals() - own_before
        p = model.parent_probability(self.parent, self.parent_tables, total)[self.word]
        c, t = total[: self.n_contexts][self.context], total[self.n_contexts : 2 * self.n_contexts][self.context]
        return (self.customers - model.discount * self.tables + (CONCENTRATION + model.discount * t) * p) / (CONCENTRATION + c)


class Model:
    """Discounts (from counts of counts), the uniform base, and the parent's predictive probability."""

    def __init__(self, totals: np.ndarray):
        one, two, parent_one, parent_two = totals[-4:]
        bounded = lambda a, b: float(np.clip(a / (a + 2 * b) if a else 0.5, 0.1, 0.9))
        self.discount, self.parent_discount = bounded(one, two), bounded(parent_one, parent_two)
        n = len(totals) // 2 - 3
        self.tokens, self.words = int(totals[:n].sum()), int(totals[2 * n + 1])
        self.base = 1.0 / (self.words + 1)

    def parent_probability(self, customers: np.ndarray, tables: np.ndarray, total: np.ndarray) -> np.ndarray:
        n = len(total) // 2 - 3
        everyone, all_tables = total[n : 2 * n].sum(), total[2 * n]
        rest = (CONCENTRATION + self.parent_discount * all_tables) * self.base
        return (customers - self.parent_discount * tables + rest) / (CONCENTRATION + everyone)

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTHING) / (self.tokens + SMOOTHING * (self.words + 1)))


@functools.lru_cache(maxsize=4)
def log_stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t) up to ``EXACT``."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, EXACT):
            t = np.arange(1, n + 2)
            stay = np.where(n - t * discount > 0, np.log(np.maximum(n - t * discount, 1e-300)) + out[n, t], -np.inf)
            out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers: Stirling's series, for small ones ten steps up."""
    x = np.asarray(x, float)
    small = x < 10
    y = np.where(small, x + 10.0, x)
    inverse = 1 / y
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inverse * (1 / 12 - inverse * inverse * (1 / 360 - inverse * inverse / 1260))
    if small.any():
        out[small] -= np.log(np.multiply.reduce([x[small] + k for k in range(10)]))
    return out


def log_stirling_large(discount: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of the generalised Stirling numbers for large n.

    Where t is small beside n ** discount their alternating sum converges within
    few terms; elsewhere they are coefficients of a power of a series, whose
    saddle point gives them to a few thousandths.
    """
    n, t = np.broadcast_arrays(np.asarray(n, float), np.asarray(t, float))
    out = np.empty(n.shape)
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        # up to there the sum's terms stay under exp(8), so that little is lost when they cancel
        rest = 1 - discount
        few = t <= min(6.0, math.exp(rest * (1 + math.log(8 / rest)))) * n**discount
        a, k = n[few], t[few]
        all_ = _log_gamma(a)
        total, choose = np.zeros(len(a)), np.zeros(len(a))
        for j in range(1, 400 if len(a) else 1):
            choose = choose + np.log(np.maximum(k - j + 1, 0) / j)
            # 1 / gamma(-x) by reflection
            size = choose + _log_gamma(np.maximum(a - j * discount, 1)) - all_ + math.lgamma(1 + j * discount)
            total += (-1) ** (j + 1) * math.sin(math.pi * j * discount) / math.pi * np.exp(size)
            if size.max() < -40:
                break
        out[few] = np.log(np.maximum(total, 1e-300)) + all_ - k * math.log(discount) - _log_gamma(k + 1)
        a, k = n[~few], t[~few]
        low, high = np.full(len(a), -21.0), np.full(len(a), 4.0)
        for _ in range(18):
            mid = (low + high) / 2
            y = np.exp(mid)
            x, g = -np.expm1(-y), -np.expm1(-discount * y) / discount
            slope = x * np.exp((1 - discount) * y) / g
            below = slope * k < a
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        m = a - k
        bend = k * slope * (1 + (1 - discount) * x * np.exp(y) - slope)
        value = k * np.log(g / x) - m * np.log(x) - 0.5 * np.log(2 * math.pi * np.maximum(bend, 1e-300))
        # near t = n the rest is a factorial, whose Stirling formula is made exact
        f = np.maximum(m, 1)
        value += 0.5 * np.log(2 * math.pi * f) + f * np.log(f) - f - _log_gamma(f + 1)
        out[~few] = np.where(m > 0, value, 0.0) + _log_gamma(a + 1) - _log_gamma(k + 1)
    return out


def _draw_large(customers: np.ndarray, other_tables: np.ndarray, p: np.ndarray, discount: float, rng: np.random.Generator, now: np.ndarray) -> np.ndarray:
    """As :func:`draw_tables` beyond ``EXACT``: the conditional's weights on a grid of table numbers.

    The grid lies around the numbers of ``now``; where it does not hold the
    weights' whole bulk, it is found by closer and closer grids over all numbers.
    """
    n, base = customers[:, None].astype(float), (CONCENTRATION + discount * other_tables[:, None]) / discount
    step_log = np.log(discount * p)[:, None]
    at = np.arange(len(customers))

    def weighed(grid: np.ndarray, some: np.ndarray) -> np.ndarray:
        return grid * step_log[some] + _log_gamma(base[some] + grid) - _log_gamma(base[some]) + log_stirling_large(discount, n[some], grid)

    def bulk(grid: np.ndarray, logs: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
        inside = logs > logs.max(axis=1, keepdims=True) - depth
        return inside.argmax(axis=1), grid.shape[1] - 1 - inside[:, ::-1].argmax(axis=1)

    between = lambda low, high, points: np.rint(low[:, None] + (high - low)[:, None] * np.linspace(0, 1, points))
    reach = 16 + 8 * np.sqrt(now)
    grid = between(np.maximum(now - reach, 1), np.minimum(now + reach, customers), 96)
    logs = weighed(grid, at)
    first, last = bulk(grid, logs, 18)
    lost = np.flatnonzero(((first == 0) & (grid[:, 0] > 1)) | ((last == 95) & (grid[:, -1] < customers)) | (last - first < 8) & (grid[:, -1] - grid[:, 0] > 95))
    if len(lost):
        low, high = np.ones(len(lost)), customers[lost].astype(float)
        for points in (48, 64, 96):
            own = np.rint(high[:, None] ** np.linspace(0, 1, points)) if points == 48 else between(low, high, points)
            found = weighed(own, lost)
            first, last = bulk(own, found, 30)
            rows = np.arange(len(lost))
            low, high = own[rows, np.maximum(first - 1, 0)], own[rows, np.minimum(last + 1, points - 1)]
        grid[lost], logs[lost] = own, found
    # a point stands for the numbers up to the middle of its gaps; points that fell together are one
    new = np.diff(grid, axis=1, prepend=0) > 0
    edges = np.concatenate([grid[:, :1] - 0.5, (grid[:, 1:] + grid[:, :-1]) / 2, grid[:, -1:] + 0.5], axis=1)
    weights = np.where(new, np.exp(logs - logs.max(axis=1, keepdims=True)), 0.0)
    width = np.maximum(np.diff(np.floor(edges), axis=1), 1)
    weights = (weights * width).cumsum(axis=1)
    pick = np.minimum((weights < rng.random((len(customers), 1)) * weights[:, -1:]).sum(axis=1), grid.shape[1] - 1)
    value, wide = grid[at, pick], width[at, pick]
    return np.clip(value + np.floor((rng.random(len(customers)) - 0.5) * wide + 0.5), 1, customers).astype(np.int64)


def draw_tables(customers: np.ndarray, other_tables: np.ndarray, p: np.ndarray, discount: float, rng: np.random.Generator, now: np.ndarray | None = None) -> np.ndarray:
    """Numbers of tables for dishes of ``customers`` (2 at least) where the restaurant has ``other_tables`` and the parent gives ``p``.

    The conditional's weights come from the numbers' recursion up to ``EXACT``
    customers, and beyond from their expansions; ``now``, the numbers before, tells where to look for these.
    """
    out = np.ones(len(customers), np.int64)
    table = log_stirling(discount)
    few = np.flatnonzero(customers <= EXACT)
    order = few[np.argsort(customers[few], kind="stable")]
    cuts = np.searchsorted(customers[order], np.arange(2, EXACT + 2))
    for n, a, b in zip(range(2, EXACT + 1), cuts[:-1], cuts[1:]):
        at = order[a:b]
        if len(at):
            steps = np.log((CONCENTRATION + discount * (other_tables[at, None] + np.arange(n))) * p[at, None])
            weights = np.cumsum(steps, axis=1) + table[n, 1 : n + 1]
            weights = np.exp(weights - weights.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[at] = 1 + (weights < rng.random((len(at), 1)) * weights[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    for at in np.split(many, range(1024, len(many), 1024)) if len(many) else ():
        out[at] = _draw_large(customers[at], other_tables[at], p[at], discount, rng, out[at] if now is None else now[at])
    return out


class _Part:
    """The words of one range, their seating, and each block's tokens."""

    def __init__(self, numbers: list[int], payloads: list[bytes], hot: Hot):
        read = []
        for block, payload in sorted(zip(numbers, payloads)):
            words, contexts, step, context, counts, held, doc = _unpack(payload, np.uint64, np.uint64, *[np.uint32] * 4, np.uint16)
            read.append((block, np.cumsum(words), np.cumsum(contexts), np.cumsum(step), context, counts, counts - held, doc))
        words, self.contexts = (np.unique(np.concatenate([r[k] for r in read])) for k in (1, 2))
        n = len(self.contexts) + 1  # the last one stands for all contexts that are not here
        keys = np.concatenate([np.searchsorted(words, r[1])[r[3]] * n + np.searchsorted(self.contexts, r[2])[r[4]] for r in read])
        keys, pair = np.unique(keys, return_inverse=True)
        customers = np.bincount(pair, np.concatenate([r[6] for r in read]), len(keys))
        cuts = np.cumsum([len(r[3]) for r in read])[:-1]
        self.blocks = [(r[0], own, r[5], r[7]) for r, own in zip(read, np.split(pair.astype(np.int32), cuts))]
        self.seating = Seating(keys // n, keys % n, customers, len(words), n, _find(hot.words, words))


def _sampled(seating: Seating, part: tuple[int, int], seed: int, sweeps: int, first: np.ndarray, second: np.ndarray | None = None, samples: int = 0, around: tuple = ()) -> np.ndarray | None:
    """Sweeps under the first totals, then ``samples`` sweeps under the second ones; the mean predictive probability of these.

    ``around`` has for each of both the shared words' customers and tables at the parent.
    """
    rng, own, model = np.random.default_rng([seed, *part]), seating.totals(), Model(first)
    if around:
        seating.surround(*around[0])
    for _ in range(sweeps):
        seating.sweep(first, own, rng, model)
    if second is None:
        return None
    own, mean = seating.totals(), 0.0
    if around:
        seating.surround(*around[1])
    for _ in range(samples):
        seating.sweep(second, own, rng, model)
        mean = mean + seating.probability(second, own, model) / samples
    return mean


# ---- totals by context -----------------------------------------------------------------------


class _Totals:
    """What all ranges share: tokens, tables, the parent's numbers, and the hot words' customers and tables."""

    def __init__(self, sums: np.ndarray, n_hot: int, parent_tables: np.ndarray | None = None):
        self.tokens, self.tables = sums[:2]
        self.customers, self.parent = sums[8 : 8 + n_hot], sums[8 + n_hot :].astype(np.int64)
        self.parent_tables = (self.parent > 0).astype(np.int64) if parent_tables is None else parent_tables
        hot = [self.parent_tables.sum(), np.count_nonzero(self.customers), 0, 0, *(np.count_nonzero(self.parent == k) for k in (1, 2))]
        self.rest = sums[2:8] + hot
        self.around = (self.parent, self.parent_tables)

    def of(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Totals as a :class:`Seating` has them, from those of its contexts."""
        return np.concatenate([customers, [self.tokens - customers.sum()], tables, [self.tables - tables.sum()], self.rest])


def _shares(seating: Seating, n_hot: int) -> np.ndarray:
    """A seating's part in the sums of :class:`_Totals`."""
    own, n = seating.totals(), seating.n_contexts
    return np.concatenate([[own[:n].sum(), own[n : 2 * n].sum()], own[2 * n :], *seating.hot(n_hot)])


def _range_of(contexts: np.ndarray, n_parts: int) -> np.ndarray:
    return ((contexts >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)


def _requests(part: int, contexts: np.ndarray, seating: Seating, n_parts: int, shares: np.ndarray, again: bool = False) -> pd.DataFrame:
    """A row per range of contexts with our contexts, customers and tables - ``again``: the tables alone -, and one (range -1) with our shares."""
    own, n = seating.totals(), seating.n_contexts
    customers, tables = own[: n - 1].astype(np.uint32), own[n : 2 * n - 1].astype(np.uint32)
    cuts = np.searchsorted(_range_of(contexts, n_parts), np.arange(n_parts + 1))
    rows = [(-1, part, again, None, shares.tolist())]
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(*cuts[r : r + 2])
        rows.append((r, part, again, _pack(tables[at]) if again else _pack(_steps(contexts[at]), customers[at], tables[at]), None))
    return pd.DataFrame(rows, columns=["range", "part", "again", "payload", "shares"])


_REQUEST = "range int, part int, again boolean, payload binary, shares array<double>"


def _replies(requests: DataFrame, warm: tuple[np.ndarray, np.ndarray, np.ndarray], n_parts: int, name: str) -> DataFrame:
    """For each part and each range of contexts the sums over all parts and the hot pairs, in the order of the part's contexts: part, range, name, payload.

    Part -1: of the hot pairs. Where a part has asked again, its tables are those of then.
    """

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        place, sent = int(frame["range"].iloc[0]), {}
        for part, payload in zip(frame["part"][~frame["again"]], frame["payload"][~frame["again"]]):
            steps, customers, tables = _unpack(payload, np.uint64, np.uint32, np.uint32)
            sent[int(part)] = np.cumsum(steps), customers, tables
        for part, payload in zip(frame["part"][frame["again"]], frame["payload"][frame["again"]]):
            sent[int(part)] = *sent[int(part)][:2], _unpack(payload, np.uint32)[0]
        here = _range_of(warm[0], n_parts) == place
        sent[-1] = tuple(x[here] for x in warm)
        contexts, back = np.unique(np.concatenate([x[0] for x in sent.values()]), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([x[k] for x in sent.values()]), len(contexts)).astype(np.int64) for k in (1, 2)]
        out, at = [], 0
        for own in sent.values():
            mine = back[at : at + len(own[0])]
            at += len(mine)
            out.append(_pack(*(x[mine] for x in sums)))
        return pd.DataFrame({"part": list(sent), "range": place, "name": name, "payload": out})

    return requests.where("range >= 0").groupBy("range").applyInPandas(add, "part int, range int, name string, payload binary")


def _context_totals(frame: pd.DataFrame, name: str, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of a part's sorted contexts: ranges follow each other as the contexts do."""
    own = frame[frame["name"] == name].sort_values("range")
    read = [_unpack(payload, np.int64, np.int64) for payload in own["payload"]]
    out = [np.concatenate([r[k] for r in read]).astype(np.float64) if read else np.empty(0) for k in (0, 1)]
    if len(out[0]) != len(contexts):
        raise RuntimeError("a range of contexts did not answer")
    return out[0], out[1]


# ---- the operator ----------------------------------------------------------------------------


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, sweeps: int = 2, samples: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from rows outside fold 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    hot, sampled = _hot_words(rows)
    n_hot = len(hot.words)
    n_parts = max(6, math.ceil(sampled * SAMPLED / PART_TOKENS))
    # every pass reads a range where the one shuffle has put it
    slices = [_blocked(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == k), hot, n_parts, k) for k in range(SLICES)]
    table = bucketed(slices, "lm-ranges", "part", min(MAX_BUCKETS, 2 * n_parts))
    texts, words = (table.where(F.col("part") >= n_parts), table.where(F.col("part") < n_parts))

    hot_counts = _hot_counts(texts, len(hot.pairs))
    hot_contexts, hot_context = np.unique(hot.pair_context, return_inverse=True)
    hot_word = np.searchsorted(hot.words, hot.pair_word)
    warm = lambda: Seating(hot_word, hot_context, hot_counts, n_hot, len(hot_contexts) + 1, np.arange(n_hot))

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        p = _Part(frame["block"].tolist(), frame["payload"].tolist(), hot)
        out = _requests(part, p.contexts, p.seating, n_parts, _shares(p.seating, n_hot))
        release_memory()
        return out

    def exchanged(requests: DataFrame, own: Seating, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        totals, n = own.totals(), own.n_contexts
        held = (hot_contexts, totals[: n - 1].astype(np.int64), totals[n : 2 * n - 1].astype(np.int64))
        replies = materialize(_replies(requests, held, n_parts, name), f"lm-{name}")
        # where no part asks, only hot pairs have contexts of a range, and there is nothing to add
        customers, tables = held[1].astype(np.float64), held[2].astype(np.float64)
        for place, payload in replies.where("part = -1").select("range", "payload").collect():
            here = _range_of(hot_contexts, n_parts) == place
            customers[here], tables[here] = _unpack(payload, np.int64, np.int64)
        return replies, _sum(requests.where(F.col("again") == (name == "second"))) + _shares(own, n_hot), customers, tables

    requests = materialize(words.groupBy("part").applyInPandas(begin, _REQUEST), "lm-begin")
    replies, sums, customers, tables = exchanged(requests, warm(), "first")
    first = _Totals(sums, n_hot)
    hot_first = first.of(customers, tables)

    def settle(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):  # a reply to the hot pairs
            return pd.DataFrame(columns=["range", "part", "again", "payload", "shares"])
        part = int(frame["part"].iloc[0])
        p = _Part(frame["block"].tolist(), frame["payload"].tolist(), hot)
        _sampled(p.seating, (part, 0), seed, sweeps, first.of(*_context_totals(got, "first", p.contexts)), around=(first.around,))
        out = _requests(part, p.contexts, p.seating, n_parts, _shares(p.seating, n_hot), again=True)
        release_memory()
        return out

    grouped = lambda frame: frame.groupBy("part")
    settled = materialize(grouped(words).cogroup(grouped(replies)).applyInPandas(settle, _REQUEST), "lm-settled")
    own = warm()
    _sampled(own, (0xFFFF, 0), seed, sweeps, hot_first, around=(first.around,))
    later, sums, customers, tables = exchanged(requests.union(settled), own, "second")
    model = Model(hot_first)
    second = _Totals(sums, n_hot, first.parent_tables)
    many = np.flatnonzero(second.parent >= 2)
    parent_tables = np.minimum(second.parent, 1)
    if len(many):
        rest = np.maximum(second.rest[0] - first.parent_tables[many], 0)
        parent_tables[many] = draw_tables(second.parent[many], rest, np.full(len(many), model.base), model.parent_discount, np.random.default_rng([seed, 0xFFFF, 1]))
    second = _Totals(sums, n_hot, parent_tables)
    around = (first.around, second.around)
    hot_probability = _sampled(warm(), (0xFFFF, 0), seed, sweeps, hot_first, second.of(customers, tables), samples, around)

    def score(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["part", "block", "payload"])
        part = int(frame["part"].iloc[0])
        p = _Part(frame["block"].tolist(), frame["payload"].tolist(), hot)
        totals = [t.of(*_context_totals(got, name, p.contexts)) for t, name in ((first, "first"), (second, "second"))]
        s = p.seating
        logs = np.log10(_sampled(s, (part, 0), seed, sweeps, *totals, samples, around))
        seen = np.bincount(s.word, s.customers, s.n_words)
        seen[~s.own] = first.customers[s.shared[~s.own]]
        base, known = model.base_log10(seen)[s.word], (seen > 0)[s.word]
        rows = []
        for block, pair, counts, doc in p.blocks:
            pair = np.repeat(pair, counts)
            rows.append((-1, block, _partial_sums(*(np.bincount(doc, x[pair]) for x in (base, logs, known)))))
        release_memory()
        return pd.DataFrame(rows, columns=["part", "block", "payload"])

    found = grouped(words).cogroup(grouped(replies.union(later))).applyInPandas(score, "part int, block long, payload binary")
    sums = materialize(found, "lm-sums")
    drop(requests, replies, settled, later)
    seen = first.customers[hot_word]
    hot_base, hot_logs, hot_known = model.base_log10(seen), np.log10(hot_probability), seen > 0

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["part"] >= 0
        d = _Documents(frame["payload"][own].iloc[0])
        doc = np.repeat(np.arange(len(d.ids)), d.per_doc)
        base, logs, known = (np.bincount(doc, x[d.codes], len(d.ids)).astype(np.float64) for x in (hot_base, hot_logs, hot_known))
        for payload in frame["payload"][~own]:
            (n,) = struct.unpack_from("<I", payload)
            used = np.frombuffer(payload, np.uint16, n, 4).astype(np.intp)
            at = 4 + 2 * n
            base[used] += np.frombuffer(payload[at : at + 8 * n], np.float64)
            logs[used] += np.frombuffer(payload[at + 8 * n : at + 12 * n], np.float32)
            known[used] += np.frombuffer(payload[at + 12 * n :], np.uint32)
        ids = pd.array(d.ids, dtype="Int64")
        ids[~d.known] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": d.held, "n_tokens": d.lengths + 1, "n_known": known.astype(np.int64), "train_tokens": model.tokens, "base_score": base, "score": logs})

    both = texts.union(sums)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = both.groupBy("block").applyInPandas(finish, out)
    result._tables = (table, sums)
    return result


def _partial_sums(base: np.ndarray, logs: np.ndarray, known: np.ndarray) -> bytes:
    """A block's documents with tokens in the range, and their sums of base, score and known tokens."""
    used = np.flatnonzero(base)
    return struct.pack("<I", len(used)) + used.astype(np.uint16).tobytes() + base[used].tobytes() + logs[used].astype(np.float32).tobytes() + known[used].astype(np.uint32).tobytes()


class _Documents:
    """A block's documents."""

    def __init__(self, payload: bytes):
        (n,) = struct.unpack_from("<I", payload)
        at = 4
        out = []
        for kind in (np.int64, np.bool_, np.bool_, np.int64, np.uint32):
            out.append(np.frombuffer(payload[at : at + n * np.dtype(kind).itemsize], kind))
            at += out[-1].nbytes
        self.ids, self.known, self.held, self.lengths, self.per_doc = out
        self.codes = np.frombuffer(payload[at:], np.uint16)


def _hot_counts(texts: DataFrame, n_hot: int) -> np.ndarray:
    """Training tokens of each hot pair."""

    def run(batches):
        sums = np.zeros(n_hot, np.int64)
        for batch in batches:
            for payload in batch.column(0):
                d = _Documents(payload.as_py())
                sums += np.bincount(d.codes[np.repeat(~d.held, d.per_doc)], minlength=n_hot)
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["code", "n"])

    out = np.zeros(n_hot, np.int64)
    for code, n in texts.select("payload").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


def _sum(requests: DataFrame) -> np.ndarray:
    """The shares of all ranges: two numbers per hot word and few more."""
    found = requests.where("range = -1").select(F.posexplode("shares").alias("k", "x")).groupBy("k").agg(F.sum("x")).collect()
    out = np.zeros(len(found))
    for k, x in found:
        out[k] = x
    return out if found else np.zeros(1)


def perplexity(scored: DataFrame) -> DataFrame:
    """One row by ``held_out``: documents, tokens, ``perplexity`` and ``base_perplexity`` (10 to the mean negative log10 of a token)."""
    tokens = F.sum("n_tokens")
    mean = lambda c: F.pow(F.lit(10.0), -F.sum(c) / tokens)
    return scored.groupBy("held_out").agg(F.count("*").alias("documents"), tokens.alias("tokens"), mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))


def release(scored: DataFrame) -> None:
    """Delete the tables behind a result that is no longer read."""
    drop(*scored._tables)
