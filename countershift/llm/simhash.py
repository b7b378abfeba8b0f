"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a common variant
within ``ceil(radius / 2)`` bits of either. Every *distinct* fingerprint emits
all such variants, one shuffle brings equal variants together, neighbours in a
variant's sorted members are verified and become links. A variant has at most
``1 + 64`` (radius 1 or 2) distinct members whatever the input holds, so no
group of copies can grow a shuffle key: copies collapse to one fingerprint
before variants are made.

Defined results: null text counts as empty; a text without words has
fingerprint zero and links like any other; fewer words than a shingle make one
shingle of them all; equal rows have equal results; a null id is kept and never
chosen as a component's id unless the component has no other; an empty table
gives no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countershift.llm.components import connected_components
from countershift.llm.shared import default_partitions, drop, materialize
from countershift.llm.text import blocks, release_memory

BITS = 64
SEED = 42
#: Ids that go are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of one text as an unsigned 64-bit number (majority of shingle hashes, strictly over half)."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total = np.zeros(BITS, np.int64), 0
    tail: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for block in blocks(data):
        own = tail + block.split()
        if len(own) < words:
            tail = own
            continue
        joined = b" ".join(own)
        # offsets of the words in the joined bytes; a shingle is a slice of them
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pairs = zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(own) - words + 1)
        ones += _bit_counts(hashes)
        total += len(hashes)
        tail = own[len(own) - words + 1 :] if words > 1 else []
    if not total:
        return digest(b" ".join(tail), SEED) if tail else 0
    set_bits = np.flatnonzero(ones * 2 > total)
    return sum(1 << int(b) for b in set_bits)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    if len(hashes) < 256:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)
    out = np.zeros(BITS, np.int64)
    for k in range(8):  # byte by byte: counts of 256 values, then the bits of the values
        counts = np.bincount(((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.intp), minlength=256)
        out[8 * k : 8 * k + 8] = counts @ _VALUE_BITS
    return out


_VALUE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (the 64 bits as a signed long). No shuffle."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(t.as_py(), words) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])
        release_memory()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def ball_masks(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``a < b`` that connect whatever distinct fingerprints ``fp`` lie within ``radius`` bits.

    Members of one variant are chained in order instead of paired with each
    other. With an even radius all of them lie within it of each other, so the
    chain loses no connection; for an odd one the neighbours' true distance
    would need all pairs, and the caller is refused.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: every two members of a variant are then linked")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius // 2)])
    # each fingerprint makes many rows: deal them out before that, not by their own small size (by a hash, or the planner takes them as dealt)
    dealt = distinct.repartition(default_partitions(distinct.sparkSession), F.hash("fp", F.lit(SEED)))
    variants = dealt.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "fp")
    w = Window.partitionBy("v").orderBy("fp")
    pairs = variants.select(F.lag("fp").over(w).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``component_id`` (least doc_id that links reach)."""
    fps = materialize(fingerprints(docs, id_col, text_col, words), "simhash-fps")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = materialize(links(distinct.select("fp"), radius), "simhash-links")
    groups = connected_components(edges)  # fp -> component's least fp; only linked fingerprints
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = materialize(named, "simhash-members")
    names = least.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = least.join(names, "component").select("fp", "component_id")
    members = materialize(members, "simhash-components")
    drop(edges, groups, least)
    return fps.join(members, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group stays.

    An id that several rows share goes only if all of them would go.
    """
    found = simhash_components(docs, id_col, text_col, words, radius).where("doc_id is not null")
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int"))
    gone = materialize(found.groupBy("doc_id").agg(stays.alias("stays")).where("stays = 0").select(F.col("doc_id").alias("gone_id_")), "simhash-gone")
    other = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(other, docs[id_col].cast("long") == other["gone_id_"], "left_anti").select(*docs.columns)


# ---- copies by shingle similarity ------------------------------------------------------------

#: 64-bit sketches of a document; each is two tables, its low and its high ``TABLE_BITS`` bits.
SKETCHES = 8
TABLE_BITS = 30
#: Leading bits by which variants are shuffled: a fingerprint is sent once for all variants that keep them, and once for each that changes one.
PREFIX_BITS = 12
#: Documents with fewer shingles have coarser sketches; their limit is that of 4 against 5 shingles.
FEW_SHINGLES, FEW_SHARE = 64, 0.19
_HASH_CHUNK = 1 << 15
#: Shingles of a chunk of a group; two chunks at most are compared by a task at a time.
UNIT_SHINGLES = 100_000


def bit_share(similarity: float) -> float:
    """Share of sketch bits in which large sets of this Jaccard similarity (and like size) differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def recall(similarity: float, bits: int = TABLE_BITS, tables: int = 2 * SKETCHES) -> float:
    """Expected chance that two such sets are within two bits in some table. It does not depend on how many documents there are."""
    p = bit_share(similarity)
    near = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return 1 - (1 - near) ** tables


def _limit(share: float) -> int:
    """Differing sketch bits that four standard deviations allow for."""
    n = SKETCHES * BITS
    return math.ceil(n * share + 4 * math.sqrt(n * share * (1 - share)))


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _shingled(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash for every ``words`` consecutive word hashes."""
    n = len(hashes) - words + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            out = _mixed(out + hashes[k : k + n])
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all words where there are fewer than a shingle's, none without a word."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    tail, found = np.empty(0, np.uint64), []
    for block in blocks(data):
        own = block.split()
        hashes = np.concatenate([tail, np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))])
        if len(hashes) >= words:
            found.append(np.unique(_shingled(hashes, words)))
            tail = hashes[len(hashes) - words + 1 :]
        else:
            tail = hashes
    if not found:
        return _shingled(tail, len(tail)) if len(tail) else tail
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


_STEPS = np.arange(1, SKETCHES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
_STREAMS = (np.arange(SKETCHES * 8) * 256).reshape(SKETCHES, 1, 8)
_VALUES = _VALUE_BITS.astype(np.float64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCHES`` SimHashes (signed longs) of a set of shingle hashes, which are mixed anew for each; zeros for the empty set."""
    ones = np.zeros((SKETCHES, BITS))
    for at in range(0, len(hashes), _HASH_CHUNK):
        with np.errstate(over="ignore"):
            mixed = _mixed(hashes[None, at : at + _HASH_CHUNK] + _STEPS)
        octets = mixed.view(np.uint8).reshape(SKETCHES, -1, 8)
        if octets.shape[1] < 64:
            ones += np.unpackbits(octets, axis=2, bitorder="little").sum(axis=1)
        else:  # counts of each byte's values, then the bits of the values
            counts = np.bincount((octets + _STREAMS).ravel(), minlength=SKETCHES * 8 * 256)
            ones += (counts.reshape(-1, 256) @ _VALUES).reshape(SKETCHES, BITS)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.int64).reshape(-1)


def _sketched(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """doc_id, n (distinct shingles), s0, s1, ... of the rows with an id. No shuffle."""
    names = ["doc_id", "n", *(f"s{k}" for k in range(SKETCHES))]

    def run(batches):
        for batch in batches:
            sizes, out = [], np.zeros((batch.num_rows, SKETCHES), np.int64)
            for k, t in enumerate(batch.column(1)):
                hashes = shingle_set(t.as_py(), words)
                sizes.append(len(hashes))
                out[k] = sketch(hashes)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int32()), *(pa.array(c) for c in out.T.copy())], names=names)
        release_memory()

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n int, " + ", ".join(f"{n} long" for n in names[2:]))


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """Of rows (component, doc_id, text): component, doc_id, h (distinct shingle hashes). No shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column(2)]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.record_batch([*part.columns[:2], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["component", "doc_id", "h"])
        release_memory()

    return texts.mapInArrow(run, "component long, doc_id long, h array<long>")


def _table_columns(bits: int) -> list:
    """The fingerprint of each table, with the table's number above its bits."""
    mask = F.lit((1 << bits) - 1).cast("long")
    places = [(k, s) for k in range(SKETCHES) for s in (0, BITS - bits)]
    return [F.shiftrightunsigned(F.col(f"s{k}"), s).bitwiseAND(mask) + F.lit(t << bits).cast("long") for t, (k, s) in enumerate(places)]


def mixed_variants(prints: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """``v``, ``fp``: the variants within one bit whose fingerprints have several groups of documents, with these fingerprints.

    ``prints`` has the distinct fingerprints ``fp`` with the least and the
    greatest group ``lo``, ``hi`` of their documents. A variant has at most
    ``1 + bits`` fingerprints whatever the input holds; one that no other
    fingerprint has stands for its own fingerprint alone. The shuffle is by
    leading bits, and variants are made behind it and added up at once, so that
    rows are made only for variants that are left.
    """
    low = bits - PREFIX_BITS
    long = lambda x: F.lit(x).cast("long")
    sent = prints.select("fp", "lo", "hi", F.explode(F.array(long(0), *[long(1 << b) for b in range(low, bits)])).alias("m"))
    sent = sent.select("fp", "lo", "hi", F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m")), low).alias("p"))
    dealt = sent.repartition(default_partitions(prints.sparkSession), "p")
    turned = F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("p")), low)
    masks = F.when(turned == 0, F.array(long(0), *[long(1 << b) for b in range(low)])).otherwise(F.array(turned))
    flag = lambda m: F.when(m == 0, long(1)).otherwise(F.shiftleft(m, 1))
    variants = dealt.select("p", "fp", "lo", "hi", F.explode(masks).alias("m"))
    variants = variants.select("p", "lo", "hi", F.col("fp").bitwiseXOR(F.col("m")).alias("v"), flag(F.col("m")).alias("flag"))
    met = variants.groupBy("p", "v").agg(F.bit_or("flag").alias("flags"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = met.where("lo < hi and (bit_count(flags) > 1 or flags = 1)")
    every = F.array(long(0), *[long(1 << b) for b in range(bits)])
    back = met.select("v", "flags", F.explode(every).alias("m")).where(F.col("flags").bitwiseAND(flag(F.col("m"))) != 0)
    return back.select("v", F.col("v").bitwiseXOR(F.col("m")).alias("fp"))


def _alike(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sketches are as close as sets of this similarity can be expected to be."""
    names = [f"s{k}" for k in range(SKETCHES)]
    sides = [sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}n"), *[F.col(s).alias(f"{x}{s}") for s in names]) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(_close("a", "b", similarity)).select("a", "b")


def _close(a: str, b: str, similarity: float) -> F.Column:
    distance = sum((F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(1, SKETCHES)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    share = bit_share(similarity)
    return distance <= F.when(F.least(f"{a}n", f"{b}n") < FEW_SHINGLES, _limit(max(share, FEW_SHARE))).otherwise(_limit(share))


def links_within(sets: list[np.ndarray], similarity: float, chunks: np.ndarray) -> list[tuple[int, int]]:
    """Places of sets that a link joins: a spanning forest of all pairs of this Jaccard similarity.

    Sets of one chunk are compared with each other; of two chunks, each set of
    the one with each of the other. Overlaps are counted by an inverted index.
    """
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    cross = chunks[0] != chunks[-1]
    values, own = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.bincount(own, minlength=len(values))
    starts = np.cumsum(holders) - holders
    postings = np.repeat(np.arange(n), sizes)[np.argsort(own, kind="stable")]
    ends = np.cumsum(sizes)
    out, label = [], np.arange(n)
    for x in range(n):
        if cross and chunks[x] == chunks[0]:
            continue
        mine = own[ends[x] - sizes[x] : ends[x]]
        mine = mine[holders[mine] > 1]
        lengths = holders[mine]
        places = np.arange(lengths.sum()) + np.repeat(starts[mine] - np.cumsum(lengths) + lengths, lengths)
        shared = np.bincount(postings[places], minlength=n)
        alike = (shared >= similarity * (sizes[x] + sizes - shared)) & (chunks != chunks[x] if cross else np.arange(n) < x)
        for group in np.unique(label[alike & (label != label[x])]).tolist():
            out.append((x, int(np.flatnonzero(alike & (label == group))[0])))
            label[label == group] = label[x]
    return out


def _verified(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links (a, b) within the groups (``node``, ``component``) that connect all pairs of this similarity in a group.

    A group is compared in units of two chunks at most, by the hash of the id, so
    that a unit holds a bounded share of a large group and gives fewer links than it has documents.
    """
    named = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(named, F.col("doc_id") == F.col("node"))
    sets = materialize(_shingle_sets(texts.select("component", "doc_id", "text"), words), "near-sets")
    large = sets.groupBy("component").agg(F.ceil(F.sum(F.size("h")) / UNIT_SHINGLES).cast("int").alias("c")).where("c > 1")
    large = materialize(large, "near-large")
    cut = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    every = sets.join(cut, "component", "left").select("component", F.pmod(F.hash("doc_id"), F.coalesce("c", F.lit(1))).alias("chunk"), F.coalesce("c", F.lit(1)).alias("c"), "doc_id", "h")
    other = every.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("k"))
    units = other.select("component", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "doc_id", "h")

    def run(batches):
        held, unit = [], None

        def done():
            found = links_within([h for _, _, h in held], similarity, np.array([c for c, _, _ in held])) if len(held) > 1 else []
            ids = [i for _, i, _ in held]
            return pa.record_batch([pa.array([max(ids[x], ids[y]) for x, y in found], pa.int64()), pa.array([min(ids[x], ids[y]) for x, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for key, chunk, doc_id, h in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                if key != unit:
                    yield done()
                    held, unit = [], key
                held.append((chunk, doc_id, h.values.to_numpy()))
        yield done()
        release_memory()

    dealt = units.repartition(default_partitions(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "chunk", "doc_id")
    out = materialize(dealt.mapInArrow(run, "a long, b long"), "near-verified")
    drop(sets, large)
    return out


def _joined(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The groups that the pairs (a, b) join; groups are stars already."""
    if pairs.isEmpty():
        return groups
    joined = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(pairs))
    drop(groups)
    return joined


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links ``a > b`` of ids, and their components (``node``, ``component``: the least id).

    Every link joins two texts whose sets of ``words``-word shingles have this
    Jaccard similarity or more. Candidates are all pairs that are within two bits
    in one of the tables of short fingerprints (:func:`recall`) and whose
    sketches of three-word shingles are close enough. None of their connections
    is lost:

    1. among the documents of one fingerprint each is paired with the one of the
       least id; close sketches make groups;
    2. in every variant that holds several groups each fingerprint's least id is
       paired with the least of all, and what is close joins its groups;
    3. variants that still hold several groups have all pairs across them
       compared by their sketches, and what is close joins its groups;
    4. inside the groups, which now hold both ends of every candidate, the
       shingle sets themselves are compared.

    So a group of near copies, most of which step 1 joins, costs a row per member and
    fingerprint, and others a row per member and variant at most, never all pairs.
    Fingerprints of a fixed ``TABLE_BITS`` also meet by chance, and such meetings
    grow with the square of the number of documents: for tables of millions take
    :func:`countershift.llm.minhash.keep_dissimilar`, which has none.
    Ids that are null or that several rows share take no part.
    """
    found = materialize(_sketched(docs, id_col, text_col), "near-sketches")
    once = found.groupBy("doc_id").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in found.columns[1:]]).where("c = 1").drop("c")
    once = materialize(once, "near-once")
    drop(found)
    rows = once.select("doc_id", F.explode(F.array(*_table_columns(TABLE_BITS))).alias("fp"))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("c")), "near-prints")
    repeated = rows.join(prints.where("c > 1").select("fp", "first_id"), "fp")
    near = materialize(_alike(repeated.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b")).where("a > b").distinct(), once, similarity), "near-pairs")
    groups = connected_components(near)
    drop(near)

    grouped = rows.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fp", F.coalesce("component", "doc_id").alias("component"))
    ends = grouped.groupBy("fp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    variants = materialize(mixed_variants(ends), "near-variants")
    # a variant has few fingerprints, so its window is small
    hub = F.min("first_id").over(Window.partitionBy("v"))
    stars = variants.join(prints.select("fp", "first_id"), "fp").select(F.col("first_id").alias("a"), hub.alias("b"))
    near = materialize(_alike(stars.where("a > b").distinct(), once, similarity), "near-pairs")
    groups = _joined(groups, near)

    # which variants are left is told by fingerprints; only these have their members listed
    named = rows.join(variants.select("fp").distinct(), "fp").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = materialize(named.select("fp", "doc_id", F.coalesce("component", "doc_id").alias("component")), "near-members")
    ends = named.groupBy("fp").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = variants.join(ends, "fp").groupBy("v").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("c > 2 and lo < hi").select("v")
    open_ = materialize(variants.join(mixed, "v").join(named, "fp").select("v", "doc_id", "component"), "near-open")
    if not open_.isEmpty():
        full = open_.join(once, "doc_id")
        one, two = (full.select("v", F.col("doc_id").alias(x), F.col("component").alias(f"{x}c"), F.col("n").alias(f"{x}n"), *[F.col(f"s{k}").alias(f"{x}s{k}") for k in range(SKETCHES)]) for x in "ab")
        across = one.join(two, (one["v"] == two["v"]) & (one["a"] > two["b"]) & (one["ac"] != two["bc"]) & _close("a", "b", similarity)).select("a", "b").distinct()
        more = materialize(across, "near-pairs")
        groups = _joined(groups, more)
        drop(more)
    drop(near, once, prints, variants, named, open_)
    links = _verified(docs, groups, id_col, text_col, words, similarity)
    drop(groups)
    return links, connected_components(links)


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but for those that verified links join to a smaller id: one document of each group stays."""
    links, groups = similar_links(docs, id_col, text_col, words, similarity)
    gone = materialize(groups.where("node <> component").select(F.col("node").alias("gone_id_")), "near-gone")
    drop(links, groups)
    other = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(other, docs[id_col].cast("long") == other["gone_id_"], "left_anti").select(*docs.columns)
