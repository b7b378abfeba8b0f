"""URL filters: host and path rules, and boosted trees for what no rule decides.

Only DataFrame functions. Rules fit a host and its subdomains where the path
starts with theirs; the longest wins. URLs that a rule decides are the labelled
ones: gradient-boosted trees learn from all of them (log loss, Newton steps) on
lexical features in fixed bins - length, depth, digit ratio, entropy, parameter
counts and what share of its suffix was blocked. That share comes from the
labelled URLs of the other ``FOLDS - 1`` folds (by the url's hash) where a
labelled one is described, so that no row's label is among its features; few or
no URLs of a suffix draw it to the share of all. Rows with equal bins and label
are one cell with a count, made once; each tree level is one aggregate over the
cells, of which the driver sees sums per (node, feature, bin), a number bounded
by the parameters. Scoring is one expression without a shuffle but the lookup of
suffixes.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged by the trees; two fitting rules of equal length: the one that
sorts first; without labelled URLs every such url is allowed; equal rows have
equal results; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.shared import drop, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1000
#: Suffixes up to this many are broadcast (a name and a number each), more are joined by a shuffle.
BROADCAST_SUFFIXES = 10_000
PRIOR = 20.0
FOLDS = 5

#: Upper ends of the bins of each feature; the last bin is open.
BINS: dict[str, tuple[float, ...]] = {
    "length": (20, 28, 36, 44, 52, 64, 80, 100, 140, 200),
    "host_length": (8, 12, 16, 20, 24, 28, 34, 42),
    "depth": (1, 2, 3, 4, 5, 6, 8),
    "digit_ratio": (0.0, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45),
    "entropy": (2.5, 3.0, 3.3, 3.6, 3.8, 4.0, 4.2, 4.4, 4.7),
    "parameters": (0, 1, 2, 3, 5),
    "hyphens": (0, 1, 2, 3, 5),
    "labels": (1, 2, 3, 4, 5),
    "digits_in_host": (0, 1, 2, 4),
    "suffix_blocked": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "domain_blocked": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
}


@dataclass(frozen=True)
class Rule:
    """``host`` (without port) and ``path`` (starts with ``/``); allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, rest = text.partition("/")
        if verdict not in ("allow", "block") or not slash or not host:
            raise ValueError(f"not a rule: {verdict} {text}")
        return cls(verdict, host.lower(), slash + rest)


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def judged(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule (null if none fits), rule_verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return rows.select("*", (none if rule is None else rule).alias("rule"), (none if verdict is None else verdict).alias("rule_verdict"))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features, and ``suffix`` and ``domain`` (the host's last one and two labels)."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.greatest(F.char_length(url), F.lit(1))
    count = lambda c, what: F.char_length(c) - F.char_length(F.regexp_replace(c, what, ""))
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.char_length(url) - F.char_length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return rows.select(
        "*", F.char_length(url).alias("length"), F.char_length(host).alias("host_length"), count(path, "/").alias("depth"),
        (count(url, "[0-9]") / n).alias("digit_ratio"), entropy.alias("entropy"), count(url, "[?&]").alias("parameters"),
        count(url, "-").alias("hyphens"), (count(host, r"\.") + 1).alias("labels"), count(host, "[0-9]").alias("digits_in_host"),
        F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"),
    )


def _fold() -> F.Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _suffix_counts(labelled: DataFrame, key: str) -> DataFrame:
    """``key``, ``<key>_y`` and ``<key>_n``: blocked and all labelled URLs by fold."""
    counts = [F.array(*[F.sum(F.when(_fold() == k, one).otherwise(0)) for k in range(FOLDS)]).alias(f"{key}_{x}") for x, one in (("y", F.col("y")), ("n", F.lit(1)))]
    table = materialize(labelled.groupBy(key).agg(*counts), "url-suffixes")
    return F.broadcast(table) if table.count() <= BROADCAST_SUFFIXES else table


def _with_shares(rows: DataFrame, tables: list[DataFrame], share: float, own: bool) -> DataFrame:
    """Add the blocked share of suffix and domain; ``own``: without the row's fold."""
    for key, table in zip(("suffix", "domain"), tables):
        rows = rows.join(table, key, "left")
        total = lambda x: F.aggregate(F.col(x), F.lit(0).cast("long"), lambda a, v: a + v)
        y, n = (total(f"{key}_{x}") - (F.element_at(f"{key}_{x}", _fold() + 1) if own else F.lit(0)) for x in "yn")
        value = (F.coalesce(y, F.lit(0)) + PRIOR * share) / (F.coalesce(n, F.lit(0)) + PRIOR)
        rows = rows.withColumn(f"{key}_blocked", value).drop(f"{key}_y", f"{key}_n")
    return rows


def _binned(rows: DataFrame) -> DataFrame:
    """Every feature as the number of its bin."""
    bins = []
    for name, ends in BINS.items():
        value = None
        for k, end in enumerate(ends):
            value = F.when(F.col(name) <= end, k) if value is None else value.when(F.col(name) <= end, k)
        bins.append(value.otherwise(len(ends)).alias(f"b_{name}"))
    return rows.select(*[c for c in rows.columns if c not in BINS], *bins)


Tree = list  # [feature, bin, left, right] (left: bin number at most this), or a leaf's value


def tree_column(tree) -> F.Column:
    if not isinstance(tree, list):
        return F.lit(float(tree))
    name, at, left, right = tree
    return F.when(F.col(f"b_{name}") <= at, tree_column(left)).otherwise(tree_column(right))


def boost(cells: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> tuple[float, list]:
    """Fit trees to ``cells`` (bin columns, ``y`` 0/1, ``n``); gives the start margin and the trees."""
    total, ones = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    if not total:
        return -1.0, []
    share = min(max(ones / total, 1e-3), 1 - 1e-3)
    start, found = math.log(share / (1 - share)), []
    if ones in (0, total):
        return start, []
    for _ in range(trees):
        margin = F.lit(start)
        for t in found:
            margin = margin + tree_column(t)
        p = 1 / (1 + F.exp(-margin))
        rows = cells.select(*[c for c in cells.columns if c not in ("y", "n")], (F.col("n") * (F.col("y") - p)).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        tree = _grow(rows, depth, rate, ridge)
        if not isinstance(tree, list):
            break
        found.append(tree)
    return start, found


def _grow(rows: DataFrame, depth: int, rate: float, ridge: float):
    """One tree, level by level; a level is one aggregate over all its nodes."""
    splits: dict[tuple, tuple] = {}  # path of 0 (left) and 1 -> (feature, bin)
    leaves: dict[tuple, float] = {}
    open_nodes: list[tuple] = [()]

    def node(path: tuple) -> F.Column:
        if path in splits:
            name, at = splits[path]
            return F.when(F.col(f"b_{name}") <= at, node((*path, 0))).otherwise(node((*path, 1)))
        return F.lit(open_nodes.index(path) if path in open_nodes else -1)

    for level in range(depth):
        pairs = F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"b_{name}").alias("b")) for k, name in enumerate(BINS)])
        long = rows.select(node(()).alias("node"), "g", "h", F.explode(pairs).alias("x")).where("node >= 0")
        sums = long.groupBy("node", F.col("x.f").alias("f"), F.col("x.b").alias("b")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        stats: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for k, f, b, g, h in sums:
            stats.setdefault(k, {}).setdefault(f, {})[b] = (g, h)
        following: list[tuple] = []
        for k, path in enumerate(open_nodes):
            g, h = (sum(v[i] for v in stats.get(k, {}).get(0, {}).values()) for i in (0, 1))
            leaves[path] = rate * g / (h + ridge)
            best, gain = None, 1e-3
            for f, name in enumerate(BINS):
                gl = hl = 0.0
                for b in sorted(stats.get(k, {}).get(f, {}))[:-1]:
                    gl, hl = gl + stats[k][f][b][0], hl + stats[k][f][b][1]
                    gr, hr = g - gl, h - hl
                    won = round(gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - g * g / (h + ridge), 6)
                    if won > gain and min(hl, hr) > 1e-3:
                        best, gain = (name, b, rate * gl / (hl + ridge), rate * gr / (hr + ridge)), won
            if best:
                splits[path] = best[:2]
                leaves[(*path, 0)], leaves[(*path, 1)] = best[2:]
                following += [(*path, 0), (*path, 1)]
        open_nodes = following
        if not following or level == depth - 1:
            break

    def build(path: tuple):
        return [*splits[path], build((*path, 0)), build((*path, 1))] if path in splits else leaves[path]

    return build(())


class Filter:
    """Suffix tables and trees, learnt from labelled rows (of :func:`lexical`, with ``y`` 0/1)."""

    def __init__(self, labelled: DataFrame, trees: int = 10, depth: int = 3):
        self.tables = [_suffix_counts(labelled, key) for key in ("suffix", "domain")]
        n, ones = labelled.agg(F.count("*"), F.sum("y")).first()
        self.share = ones / n if n else 0.5
        bins = [f"b_{name}" for name in BINS]
        cells = materialize(_binned(_with_shares(labelled, self.tables, self.share, True)).groupBy(*bins, "y").agg(F.count("*").alias("n")), "url-cells")
        self.start, self.trees = boost(cells, trees, depth)
        drop(cells)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows with ``block_score``, the trees' probability."""
        margin = F.lit(self.start)
        for t in self.trees:
            margin = margin + tree_column(t)
        return _binned(_with_shares(rows, self.tables, self.share, False)).withColumn("block_score", 1 / (1 + F.exp(-margin)))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where("rule is not null").withColumn("y", (F.col("rule_verdict") == "block").cast("int"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, trees: int = 10, depth: int = 3) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and ``block_score`` (the trees' probability)."""
    rows = lexical(judged(pages, rules, id_col, url_col))
    out = Filter(_labelled(rows), trees, depth).scored(rows)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def held_out_loss(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", trees: int = 10, depth: int = 3) -> DataFrame:
    """One row: labelled URLs of fold 0, the log loss of trees learnt from the other folds, that of their blocked share alone, and how many verdicts are right."""
    labelled = _labelled(lexical(judged(pages, rules, id_col, url_col)))
    found = Filter(labelled.where(_fold() != 0), trees, depth)
    loss = lambda p: -F.avg(F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p)))
    share = F.lit(min(max(found.share, 1e-6), 1 - 1e-6))
    right = F.avg(((F.col("block_score") >= 0.5) == (F.col("y") == 1)).cast("double"))
    return found.scored(labelled.where(_fold() == 0)).agg(F.count("*").alias("urls"), loss(F.col("block_score")).alias("log_loss"), loss(share).alias("base_log_loss"), right.alias("accuracy"))
