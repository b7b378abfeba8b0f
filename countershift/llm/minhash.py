"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's sketch is the ``SKETCH`` least hashes of its shingles. Two sets of
Jaccard similarity s share each of the least hashes of their union with chance
s, so inverted lists of few retained values bring similar documents together,
the least hashes of two sketches' union estimate the similarity of what met,
and the full sets of what passes are compared exactly. A link is therefore
never wrong; a similar pair is missed with a chance of about ``LOSS`` in each of
two places (no common indexed value, an estimate far too low), and sets within
the sketch's size are compared without chance.

How hot values and large groups are kept from growing:

* documents of equal sets are one node before anything is compared;
* a value in the ``INDEXED`` least of more than ``HOT`` nodes (a passage that
  many documents share) is not indexed for a document that has enough other
  values; how many it needs follows from how many of its values are hot
  (:func:`index_size`), so nothing is lost. Nodes nearly all of whose values are
  hot are near copies of each other or nearly so, and are indexed by them;
* a list first pairs its nodes with one of them, so a group of near copies costs
  a row per node and list;
* lists that still hold several components compare the sketches of nodes of
  different components, in units of two bounded chunks; nodes of a list's
  largest component are sent only to chunks of the others. A node proposes its
  best few partners, links join components, then more, and in the last round all
  that are left: every pair that passes the estimate was compared or joined;
* a text that many are compared with is sent once for ``BANK`` of them.

The number of compared sketches can still be quadratic for one family: documents
that share a passage making up nearly all of each (about 75 to 92 % of their
shingles at a similarity of 0.85) without being similar enough.

Defined results: null text counts as empty; no words give the empty set, which
links with nothing; fewer words than a shingle's make one shingle of all; equal
rows have equal results; a null id is kept and names its component only where no
other does; an empty table gives no rows. Sets are of 64-bit hashes. Further
columns of the input are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.components import connected_components
from countershift.llm.shared import default_partitions, drop, materialize
from countershift.llm.simhash import shingle_set
from countershift.llm.text import release_memory, runs

SKETCH = 256
#: Of a sketch, the least values that inverted lists may hold.
INDEXED = 64
LOSS = 1e-5
#: Nodes from which on a value is hot.
HOT = 1000
#: Nodes of a chunk of a list, and partners of one text in a task.
CHUNK, BANK = 512, 256
#: Partners that a node proposes in a round; in the last, all.
ROUNDS = (4, 64, 1 << 40)
#: Rows of narrow tables that are broadcast (checked); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def least_shared(percent: int, k: int = SKETCH) -> int:
    """Of the ``k`` least values of a union, how many two sets of this similarity share but for a chance of ``LOSS``."""
    p, below = percent / 100, 0.0
    for s in range(k + 1):
        below += math.comb(k, s) * p**s * (1 - p) ** (k - s)
        if below > LOSS:
            return s
    return k


def index_size(cold: int, hot: int, percent: int) -> tuple[int, int]:
    """How many cold and how many hot values of a sketch's least ``cold + hot`` are indexed, in order of the values.

    Of a partner's, at most a share of ``1 - percent / 100`` is foreign. In the worst case all foreign values are cold ones, and ``c`` of them are
    all foreign with chance ``(foreign / cold) ** c``. Where the cold ones don't suffice all are indexed, as partners' may, and hot ones by the same rule.
    """
    foreign = (1 - percent / 100) * (cold + hot)
    need = lambda m: math.ceil(math.log(LOSS) / math.log(foreign / m)) if m > foreign else m + 1
    if need(cold) <= cold:
        return need(cold), 0
    return cold, min(hot, need(hot))


def chosen(values: np.ndarray, n: int, hot_bits: int, percent: int) -> np.ndarray:
    """The indexed values of a node of ``n`` shingles; ``hot_bits`` flags the hot ones of its least."""
    values = values[:INDEXED]
    hot = (np.uint64(hot_bits) >> np.arange(len(values), dtype=np.uint64)) & np.uint64(1) == 1 if hot_bits else np.zeros(len(values), bool)
    cold_values, hot_values = values[~hot], values[hot]
    if n * 100 <= INDEXED * percent:  # partners are indexed whole too: with so many foreign values at most, one of the first must be common
        c = n * (100 - percent) // 100 + 1
        return np.concatenate([cold_values, hot_values])[:c]
    c, h = index_size(len(cold_values), len(hot_values), percent)
    return np.concatenate([cold_values[:c], hot_values[:h]])


def agreement(x: np.ndarray, nx: int, sketches: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Estimated similarity of the sketch ``x`` with each row of ``sketches`` (padded to one width), -1 where it can't reach ``percent``."""
    place = np.minimum(np.searchsorted(x, sketches), len(x) - 1)
    column = np.arange(sketches.shape[1])
    same = (x[place] == sketches) & (column < lengths[:, None])
    shared = same.sum(axis=1)
    rank = place + column + 2 - np.cumsum(same, axis=1)  # in the union
    counted = (same & (rank <= SKETCH)).sum(axis=1)
    whole = (nx <= SKETCH) & (sizes <= SKETCH)  # the sketches are the sets
    union = nx + sizes - shared
    good = np.where(whole, 100 * shared >= percent * union, counted >= least)
    good &= 100 * np.minimum(sizes, nx) >= percent * np.maximum(sizes, nx)
    return np.where(good, np.where(whole, shared / np.maximum(union, 1), counted / SKETCH), -1.0)


def padded(sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = np.full((len(sketches), max(1, int(lengths.max(initial=0)))), np.iinfo(np.uint64).max, np.uint64)
    for k, s in enumerate(sketches):
        out[k, : len(s)] = s
    return out, lengths


def proposals(sketches: list[np.ndarray], sizes: np.ndarray, components: np.ndarray, sides: np.ndarray, limit: int, percent: int) -> list[tuple[int, int, bool]]:
    """Places (x, y) of members of different components (and sides, where there are two) whose sketches agree, and whether x has more partners than shown.

    Each member has its ``limit`` best partners. Candidates share a value among the locally rarest of both, so many that every pair that agrees does.
    """
    n, least = len(sketches), least_shared(percent)
    table, lengths = padded(sketches)
    values, own = np.unique(np.concatenate(sketches), return_inverse=True)
    holders = np.bincount(own, minlength=len(values))
    at = np.concatenate(([0], np.cumsum(lengths)))
    prefixes = []
    for x in range(n):
        mine = own[at[x] : at[x + 1]]
        mine = mine[np.lexsort((mine, holders[mine]))]
        # sketches of so small sets are the sets, as are their partners'
        shared = -(-percent * sizes[x] // 100) if sizes[x] * 100 <= SKETCH * percent else least
        prefix = mine[: max(1, len(mine) - int(shared) + 1)]
        prefixes.append(prefix[holders[prefix] > 1])
    postings = np.repeat(np.arange(n), list(map(len, prefixes)))
    keys = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, postings = keys[order], postings[order]
    two = sides.min() != sides.max()
    out = []
    for x in range(n):
        if two and sides[x]:
            continue
        lo, hi = np.searchsorted(keys, prefixes[x]), np.searchsorted(keys, prefixes[x], side="right")
        spans = [postings[a:b] for a, b in zip(lo, hi)]
        if not spans:
            continue
        ys = np.unique(np.concatenate(spans))
        ys = ys[(components[ys] != components[x]) & (sides[ys] == 1 if two else ys > x)]
        if not len(ys):
            continue
        score = agreement(sketches[x], sizes[x], table[ys], lengths[ys], sizes[ys], percent, least)
        ys, score = ys[score >= 0], score[score >= 0]
        best = np.argsort(-score, kind="stable")[:limit]
        out += [(x, int(y), len(ys) > limit) for y in ys[best]]
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, row (a number), text_key, n, d1 and d2 (digest of the set), sketch. No shuffle."""

    def run(batches):
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for t in batch.column(2):
                hashes = shingle_set(t.as_py(), words)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sketches.append(hashes[:SKETCH].view(np.int64))
            ends = np.cumsum([0, *map(len, sketches)], dtype=np.int32)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64)))
            yield pa.record_batch([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), held], names=["doc_id", "text_key", "n", "d1", "d2", "sketch"])
        release_memory()

    out = _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_key binary, n long, d1 long, d2 long, sketch array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"), text.alias("text"))


def _sized(df: DataFrame) -> DataFrame:
    """A materialized narrow table, to be broadcast up to a checked number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """v, node, n (the node's shingles): the inverted lists of the indexed values."""
    least = nodes.select("node", F.posexplode(F.slice("sketch", 1, INDEXED)).alias("place", "v"))
    hot = materialize(least.groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("v"), "minhash-hot")
    own = nodes.select("node", "n", F.slice("sketch", 1, INDEXED).alias("s"))
    if hot.count() <= BROADCAST_ROWS:  # looked up where the nodes are, so that members of long lists make no rows
        few = np.sort(np.array([v for (v,) in hot.collect()], np.int64))
        flagged = own.withColumn("hot_bits", F.lit(None).cast("long"))
    else:
        few = None
        flags = least.join(hot, "v").groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("hot_bits"))
        flagged = own.join(flags, "node", "left")

    def run(batches):
        for batch in batches:
            ids, ns, bits = (batch.column(k).to_pylist() for k in (0, 1, 3))
            if few is not None and len(few):
                held = [s.values.to_numpy() for s in batch.column(2)]
                hits = [few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x for x in held]
                bits = [int((hit.astype(np.uint64) << np.arange(len(hit), dtype=np.uint64)).sum()) for hit in hits]
            found = [chosen(s.values.to_numpy().view(np.uint64), n, (b or 0) % (1 << 64), percent) for n, b, s in zip(ns, bits, batch.column(2))]
            node = np.repeat(np.array(ids, np.int64), list(map(len, found)))
            size = np.repeat(np.array(ns, np.int64), list(map(len, found)))
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)), pa.array(node), pa.array(size)], names=["v", "node", "n"])

    return materialize(flagged.mapInArrow(run, "v long, node long, n long"), "minhash-lists")


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sketches agree."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s")) for x in "ab")
    least = least_shared(percent)

    def run(batches):
        for batch in batches:
            n = [batch.column(k).to_numpy() for k in (2, 4)]
            good = np.zeros(batch.num_rows, bool)
            for k, (s, t) in enumerate(zip(batch.column(3), batch.column(5))):
                if 100 * min(n[0][k], n[1][k]) >= percent * max(n[0][k], n[1][k]):
                    x, y = (v.values.to_numpy().view(np.uint64) for v in (s, t))
                    good[k] = agreement(x, n[0][k], y[None], np.array([len(y)]), n[1][k : k + 1], percent, least)[0] >= 0
            yield batch.filter(pa.array(good)).select([0, 1])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "an", "as", "bn", "bs")
    return both.mapInArrow(run, "a long, b long")


def _compared(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``a``, ``b``, ``linked`` of all pairs: whether the full shingle sets have the similarity. ``b`` should be the side that repeats."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = materialize(nodes.join(wanted, "node").select("node", F.col("doc_id").alias("node_id"), F.col("text_key").alias("node_key")), "minhash-keys")
    of = _keyed(docs, id_col, text_col)
    texts = of.join(_sized(keys), of["doc_id"].eqNullSafe(F.col("node_id")) & (of["text_key"] == F.col("node_key"))).select("node", "text")
    texts = materialize(texts, "minhash-texts")
    crowded = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / BANK).alias("banks")).where("banks > 1"), "minhash-crowded")
    dealt = pairs.join(_sized(crowded), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("banks", F.lit(1))).alias("bank"))
    dealt = materialize(dealt, "minhash-dealt")
    firsts = dealt.select("b", "bank").distinct().join(texts.withColumnRenamed("node", "b"), "b").select("b", "bank", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("a"), "text")
    others = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "bank", F.lit(1).alias("tag"), "a", "text")

    def run(batches):
        at, first, before = None, None, None
        for batch in batches:
            found = []
            for b, bank, tag, a, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if (b, bank, a) == before:  # one text of several rows with one id
                    continue
                before = (b, bank, a)
                if not tag:
                    at, first = (b, bank), shingle_set(text.as_py(), words)
                    continue
                assert at == (b, bank), "the first row of a bank holds its text"
                own = shingle_set(text.as_py(), words)
                shared = len(np.intersect1d(own, first, assume_unique=True))
                found.append((a, b, 100 * shared >= percent * (len(own) + len(first) - shared)))
            yield pa.record_batch([pa.array([x[k] for x in found], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))], names=["a", "b", "linked"])
        release_memory()

    rows = firsts.union(others).repartition(default_partitions(docs.sparkSession), "b", "bank").sortWithinPartitions("b", "bank", "tag", "a")
    out = materialize(rows.mapInArrow(run, "a long, b long, linked boolean"), "minhash-compared")
    drop(keys, texts, crowded, dealt)
    return out


def _proposed(lists: DataFrame, groups: DataFrame, nodes: DataFrame, limit: int, percent: int) -> DataFrame:
    """``a``, ``b``, ``more``: for nodes of lists that hold several components, the best partners of other components."""
    named = lists.join(groups, "node", "left").select("v", "node", F.coalesce("component", "node").alias("component"))
    open_ = named.groupBy("v").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("c > 2 and lo < hi").select("v", "c")
    open_ = materialize(open_, "minhash-open")
    members = materialize(named.join(_sized(open_), "v"), "minhash-members")
    large = members.where(F.col("c") > CHUNK).groupBy("v", "component").agg(F.count("*").alias("own"), F.max("c").alias("c"))
    most = large.groupBy("v").agg(F.max(F.struct("own", "component")).alias("m"), F.max("c").alias("c"))
    chunks = lambda x: F.greatest(F.lit(1), F.ceil(x / CHUNK)).cast("int")
    cut = materialize(most.select("v", F.col("m.component").alias("main"), chunks(F.col("c") - F.col("m.own")).alias("few"), chunks(F.col("m.own")).alias("many")), "minhash-cut")
    rows = members.join(_sized(cut), "v", "left")
    other = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    key = ["v", "kind", "i", "j"]
    zero = F.lit(0)
    whole = rows.where("main is null").select("v", zero.alias("kind"), zero.alias("i"), zero.alias("j"), zero.alias("side"), "node", "component")
    main = rows.where("component = main").select("*", chunk("many").alias("d"), F.explode(other("few")).alias("i")).select("v", F.lit(1).alias("kind"), "i", F.col("d").alias("j"), F.lit(1).alias("side"), "node", "component")
    rest = rows.where("component <> main").withColumn("d", chunk("few"))
    against = rest.select("*", F.explode(other("many")).alias("j")).select("v", F.lit(1).alias("kind"), F.col("d").alias("i"), "j", zero.alias("side"), "node", "component")
    among = rest.select("*", F.explode(other("few")).alias("k")).select("v", F.lit(2).alias("kind"), F.least("d", "k").alias("i"), F.greatest("d", "k").alias("j"), (F.col("d") > F.col("k")).cast("int").alias("side"), "node", "component")
    units = whole.union(main).union(against).union(among)
    full = units.join(nodes.select("node", "n", "sketch"), "node").select(*key, "side", "node", "component", "n", "sketch")

    def run(batches):
        for unit in runs(batches, 4):
            side, node, component, n = (unit.column(k).to_numpy() for k in (4, 5, 6, 7))
            found = []
            if component.min() != component.max():
                found = proposals([s.values.to_numpy().view(np.uint64) for c in unit.column(8).chunks for s in c], n, component, side, limit, percent)
            yield pa.record_batch([pa.array([node[x] for x, _, _ in found], pa.int64()), pa.array([node[y] for _, y, _ in found], pa.int64()), pa.array([m for _, _, m in found], pa.bool_())], names=["a", "b", "more"])

    dealt = full.repartition(default_partitions(lists.sparkSession), *key).sortWithinPartitions(*key, "node")
    made = dealt.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))
    out = materialize(made, "minhash-proposed")
    drop(open_, members, cut)
    return out


def _linked(tried: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, tried).where("linked").select("a", "b")


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (least doc_id that links of ``percent`` reach), ``kept`` (it names its component)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    found = materialize(_sets(docs, id_col, text_col, words), "minhash-sets")
    classes = found.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("c"))
    classes = materialize(classes, "minhash-classes")
    short = found.select("row", "n", F.slice("sketch", 1, INDEXED).alias("sketch"))
    heads = materialize(classes.select("node").join(short, F.col("node") == F.col("row")).select("node", "n", "sketch"), "minhash-heads")
    every = _lists(heads, percent)

    # only lists of several nodes are kept, and whole sketches only of their nodes
    hubs = every.groupBy("v").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    lists = materialize(every.join(hubs.select("v", F.col("hub.node").alias("b"), F.col("hub.n").alias("bn")), "v"), "minhash-shared")
    held = materialize(lists.select("node").distinct(), "minhash-held")
    nodes = found.join(_sized(held), F.col("row") == F.col("node")).select("node", "doc_id", "text_key", "n", "sketch")
    nodes = materialize(nodes, "minhash-nodes")
    own = materialize(found.select("doc_id", "n", "d1", "d2"), "minhash-own")
    drop(found, heads, every, held)

    near = lists.where("node <> b").where(100 * F.least("n", "bn") >= percent * F.greatest("n", "bn"))
    stars = near.select(F.col("node").alias("a"), "b").distinct()
    pairs = materialize(_agreeing(stars, nodes, percent), "minhash-pairs")
    tried = [_compared(docs, pairs, nodes, id_col, text_col, words, percent)]
    drop(pairs)
    groups = connected_components(_linked(tried))
    for limit in ROUNDS:
        made = _proposed(lists, groups, nodes, limit, percent)
        pairs = made.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        known = functools.reduce(DataFrame.union, tried).where("not linked").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        fresh = materialize(pairs.join(known, ["a", "b"], "left_anti"), "minhash-pairs")
        held_back = not made.where("more").isEmpty()
        if not fresh.isEmpty():
            tried.append(_compared(docs, fresh, nodes, id_col, text_col, words, percent))
            drop(groups)
            groups = connected_components(_linked(tried))
        drop(made, fresh)
        if not held_back:
            break

    named = classes.join(groups, "node", "left").select("d1", "d2", "first_id", "c", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "minhash-named")
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = materialize(named.join(names, "component").select("d1", "d2", "c", "component_id"), "minhash-components")
    drop(classes, nodes, lists, named, groups, *tried)
    # sets of very many rows are looked up without moving these rows
    hot = F.col("c") > HOT
    crowded = materialize(members.where(hot).select("d1", "d2", F.struct("component_id").alias("crowd")), "minhash-crowds")
    looked = own.where("n > 0").join(_sized(crowded), ["d1", "d2"], "left")
    rare = looked.where("crowd is null").join(members.where(~hot), ["d1", "d2"]).select("doc_id", "n", "component_id")
    every = looked.where("crowd is not null").select("doc_id", "n", "crowd.component_id").union(rare)
    every = every.union(own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose id names their component; an id that several rows share goes only if all of them would go."""
    found = minhash_components(docs, id_col, text_col, words, percent).where("doc_id is not null")
    gone = materialize(found.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("stays")).where("stays = 0").select(F.col("doc_id").alias("gone_id_")), "minhash-gone")
    return docs.join(_sized(gone), docs[id_col].cast("long") == gone["gone_id_"], "left_anti").select(*docs.columns)
