"""Exact duplicates by an extendible-hash index on shared files (DataFrame operations only).

1. One scan writes a *slot* per row to shared Parquet: id, 64-bit key of the
   normalised text, the original's code points, SHA-256.
2. A directory over the keys' leading bits is built from counts per prefix.
   It starts with one bucket and doubles while a bucket is over its capacity;
   only overfull buckets split. The directory has at most ``2 ** MAX_DEPTH``
   entries, whatever the input, and is a table of its own.
3. Slots are written to the files of the bucket that the directory names. Keys
   with over a thousandth of all slots (a thousand at most) would overfill any
   bucket; their slots go to overflow buckets, dealt by slot.
4. Owner tasks read the files of their buckets and chain the slots of a key and
   digest there; no slot moves again. Chains of overflow buckets are counted in
   each, and the counts are added up and looked up by broadcast.
5. Bytes are compared where a key is chained more than once: these rows' texts
   are read again and grouped by key *and* bytes, copies combined before the
   shuffle. The groups must be the owners' chains.

Defined results: null text counts as empty and equals any text of white space;
ties on code points go to the smaller doc_id, null ids last, and among rows
equal in both to one row; further columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countershift.llm.shared import bucketed, default_partitions, drop, materialize

#: White space that the normal form deletes.
SPACE = r"[\x20\x09-\x0D]"
MAX_DEPTH = 14
#: A key with more than a ``1 / HOT_SHARE`` part of all slots is hot; there can't be more than ``HOT_SHARE`` of them.
HOT_SHARE = 1000
#: Chained keys up to this many are broadcast (9 bytes each), more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows that go, of three numbers each, are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Directory:
    """``entries[prefix]`` is the bucket of keys with these ``depth`` leading bits."""

    depth: int
    entries: tuple[int, ...]

    @property
    def buckets(self) -> int:
        return max(self.entries) + 1

    def located(self, slots: DataFrame) -> DataFrame:
        """``slots`` with the ``bucket`` of their ``key``: a look-up by broadcast in at most ``2 ** MAX_DEPTH`` rows."""
        table = slots.sparkSession.createDataFrame(list(enumerate(self.entries)), "prefix int, bucket int")
        # a shift by 64 is none
        prefix = F.shiftrightunsigned("key", 64 - self.depth).cast("int") if self.depth else F.lit(0)
        return slots.withColumn("prefix", prefix).join(F.broadcast(table), "prefix").drop("prefix")


def build_directory(counts: dict[int, int], depth: int, capacity: int) -> Directory:
    """Extendible hashing over counts per ``depth``-bit prefix: split overfull buckets, double the directory as needed."""
    leaves, todo = [], [(0, 0)]  # (local depth, prefix)
    totals = {(depth, p): n for p, n in counts.items()}
    for d in range(depth - 1, -1, -1):
        for (k, p), n in list(totals.items()):
            if k == d + 1:
                totals[d, p >> 1] = totals.get((d, p >> 1), 0) + n
    while todo:
        d, p = todo.pop()
        if totals.get((d, p), 0) > capacity and d < depth:
            todo += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
        else:
            leaves.append((d, p))
    top = max(d for d, _ in leaves)
    entries = [0] * (1 << top)
    for number, (d, p) in enumerate(leaves):
        first = p << (top - d)
        entries[first : first + (1 << (top - d))] = [number] * (1 << (top - d))
    return Directory(top, tuple(entries))


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).alias("n_chars"), normalised(text).alias("norm"))
    return rows.withColumn("key", F.xxhash64("norm"))


@dataclass
class Index:
    """The directory, and the slots in the files of their buckets: those from ``directory.buckets`` on are overflow."""

    directory: Directory
    pages: DataFrame


def _best() -> F.Column:
    """What orders the rows of a chain: the least stays."""
    return F.struct((-F.col("n_chars")).alias("rank"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("slot").alias("slot"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2_000) -> Index:
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    slots = materialize(keyed.select("doc_id", "key", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("slot")), "dedup-slots")
    n = slots.count()
    hot = [r["key"] for r in slots.groupBy("key").count().where(F.col("count") > n // HOT_SHARE + 1).collect()]
    marked = slots.join(F.broadcast(spark.createDataFrame([(k, True) for k in hot], "key long, hot boolean")), "key", "left")
    counts = {r[0]: r[1] for r in marked.where("hot is null").groupBy(F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")).count().collect()}
    directory = build_directory(counts, MAX_DEPTH, max(capacity, n >> (MAX_DEPTH - 2)))
    overflow = default_partitions(spark)
    bucket = F.when(F.col("hot"), F.lit(directory.buckets) + F.pmod("slot", F.lit(overflow)).cast("int")).otherwise(F.col("bucket"))
    files = min(directory.buckets + overflow, 4 * default_partitions(spark))
    pages = bucketed([directory.located(marked).withColumn("bucket", bucket).drop("hot")], "dedup-pages", "bucket", files)
    drop(slots)
    return Index(directory, pages)


def _compared(docs: DataFrame, chains: DataFrame, pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, sha, group_size of the texts of repeated keys, grouped by their bytes."""
    keys = materialize(chains.where("group_size > 1").select("key").distinct(), "dedup-chained")
    small = keys.count() <= BROADCAST_KEYS
    named = F.broadcast(keys) if small else keys
    ids = materialize(pages.join(named, "key", "left_semi").select(F.col("doc_id").alias("again_id_")).distinct(), "dedup-again")
    again = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    read = docs.join(again, docs[id_col].cast("long").eqNullSafe(again["again_id_"]), "left_semi")
    texts = _keyed(read, id_col, text_col).select("key", "norm").join(named, "key", "left_semi").groupBy("key", "norm").agg(F.count("*").alias("group_size"))
    out = materialize(texts.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size"), "dedup-bytes")
    drop(keys, ids)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and ``key``, ``n_chars``."""
    index = build_index(docs, id_col, text_col, capacity)
    pages, first_overflow = index.pages, index.directory.buckets
    # pages lie by bucket, so owners chain without a shuffle; only counts of overflow buckets are added up
    counted = pages.groupBy("bucket", "key", "sha").agg(F.count("*").alias("group_size"), F.min(_best()).alias("best"))
    hot = counted.where(F.col("bucket") >= first_overflow).groupBy("key", "sha").agg(F.sum("group_size").alias("group_size"), F.min("best").alias("best"))
    hot = materialize(hot, "dedup-hot")
    chains = counted.where(F.col("bucket") < first_overflow).select("key", "sha", "group_size").union(hot.select("key", "sha", "group_size"))
    chains = materialize(chains.where("group_size > 1"), "dedup-chains")
    compared = _compared(docs, chains, pages, id_col, text_col)
    differ = chains.join(compared.where("group_size > 1").withColumnRenamed("group_size", "by_bytes"), ["key", "sha"], "full")
    if not differ.where(~F.col("group_size").eqNullSafe(F.col("by_bytes"))).isEmpty():
        raise ArithmeticError("texts of one digest differ in their bytes")
    drop(chains, compared)
    chain = Window.partitionBy("bucket", "key", "sha")
    cool = pages.where(F.col("bucket") < first_overflow).select("*", F.count("*").over(chain).alias("group_size"), F.min(_best()).over(chain).alias("best"))
    small = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    spread = pages.where(F.col("bucket") >= first_overflow).join(small, ["key", "sha"])
    out = cool.unionByName(spread)
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("slot") == F.col("best.slot")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "key", "n_chars",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat a kept row whole (id and text) stay once."""
    names = ["dedup_id_", "dedup_key_", "dedup_n_"]
    groups = exact_groups(docs, id_col, text_col).select("kept", *[F.col(c).alias(n) for c, n in zip(("doc_id", "key", "n_chars"), names)])
    groups = materialize(groups, "dedup-groups")
    kept, gone = groups.where("kept").drop("kept"), groups.where("not kept").drop("kept").distinct()
    repeats = materialize(_matched(gone, kept, names, "left_semi"), "dedup-repeats")  # a row goes and its like stays
    gone = materialize(_matched(gone, repeats, names, "left_anti"), "dedup-gone")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).cast("long"), F.xxhash64(normalised(F.col(text_col))), F.char_length(text)]
    rows = docs.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    stay = _matched(rows, gone, names, "left_anti", small=gone.count() <= BROADCAST_ROWS)
    if not repeats.isEmpty():
        once = _matched(stay, repeats, names, "left_semi").dropDuplicates(names)
        stay = _matched(stay, repeats, names, "left_anti").unionByName(once)
    return stay.select(*docs.columns)


def _matched(left: DataFrame, right: DataFrame, names: list[str], how: str, small: bool = False) -> DataFrame:
    """Join on ``names``, where null equals null; ``small``: the right side's size was checked."""
    other = right.select(*[F.col(n).alias(f"{n}r") for n in names])
    if small:
        other = F.broadcast(other)
    on = None
    for n in names:
        part = left[n].eqNullSafe(other[f"{n}r"])
        on = part if on is None else on & part
    return left.join(other, on, how)
