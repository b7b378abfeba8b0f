"""Bottom-k near-duplicates against all pairs of full shingle sets."""

import re

import duckdb
import numpy as np
import pytest

from countershift.llm import minhash, queries

SCHEMA = "doc_id long, text string, n long, row long, node long, v long, sketch string, component_id long, kept string, a int, b int"


def shingles(text, words=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(ws[k : k + words]) for k in range(len(ws) - words + 1)} if len(ws) >= words else {" ".join(ws)} - {""}


def brute(rows, percent=85):
    """The contract by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    label, holders = list(range(len(rows))), {}
    for k, s in enumerate(sets):
        met = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(k)
        for j, shared in met.items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared) and label[j] != label[k]:
                old, new = label[k], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(i, len(s), least.get(x), i == least.get(x)) for (i, _), s, x in zip(rows, sets, label)]


def key(row):
    return tuple((x is not None, x) for x in row)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 0, 1, 1, 1, "s", 1, "k", 2, 3) for i, t in rows], SCHEMA).repartition(parts)


def check(spark, rows, percent=85):
    found = [tuple(r) for r in minhash.minhash_components(frame(spark, rows), percent=percent).collect()]
    assert sorted(found, key=key) == sorted(brute(rows, percent), key=key)


def families(rng, n):
    """Near copies around a base, chains of edits, and documents around a passage of every share."""
    rows, number = [], 0

    def add(words):
        nonlocal number
        rows.append((number := number + 1, " ".join(words)))

    for size in (8, 30, 60, 100, 140, 400):
        base = [f"b{size}x{k}" for k in range(size)]
        for _ in range(n):
            own = list(base)
            for place in rng.integers(0, size, int(rng.integers(0, 2 + size // 40))):
                own[place] = f"e{number}x{place}"
            add(own[: size - int(rng.integers(0, 1 + size // 30))])
        for k in range(n):  # each like the next
            add([f"c{size}x{j + k * max(1, size // 20)}" for j in range(size)])
        for share in (0.5, 0.7, 0.8, 0.88, 0.95):
            cut = int(size * share)
            for _ in range(n):
                add(base[:cut] + [f"o{number}x{k}" for k in range(size - cut)])
    return rows


EDGES = [
    (1, "The cat sat on the mat"), (2, "the  CAT sat\ton the\x0bmat"), (3, None), (4, ""), (5, " \n"), (6, "one two"), (7, "ONE two"), (8, "one two three"), (9, "é İ ẛ̣ 中文 👍🏽 x"), (10, "É İ ẛ̣ 中文 👍🏽 x"),
    (11, "wort " * 40_000), (12, "wort " * 20), (13, " ".join(f"w{k}" for k in range(30_000))), (14, " ".join(f"w{k}" for k in range(29_000))), (15, " ".join(f"w{k}" for k in range(20_000))), (16, "x" * 100_000),
    (None, "the null id of one two three"), (None, "the null id of one two three"), (17, "the null id of one two three"), (None, "alone with a null id here"), (None, None),
    (18, "same id and another text here"), (18, "same id but quite different words there"), (19, "same id but quite different words there"), (-3, "same id and another text here"),
    *[(20, "repeated row of six words here")] * 30,
]


def test_edges_equal_all_pairs(spark):
    check(spark, EDGES)
    assert minhash.minhash_components(frame(spark, EDGES).where("false")).collect() == []
    kept = minhash.keep_dissimilar(frame(spark, EDGES))
    assert kept.columns == frame(spark, EDGES).columns
    stays = {i for i, _, _, k in brute(EDGES) if k}
    assert sorted([r.doc_id for r in kept.collect()], key=lambda x: (x is not None, x)) == sorted([i for i, _ in EDGES if i is None or i in stays], key=lambda x: (x is not None, x))


@pytest.mark.parametrize("limits", [{}, {"HOT": 5, "CHUNK": 8, "BANK": 3, "ROUNDS": (1, 2, 1 << 40), "BROADCAST_ROWS": 0}])
def test_families_equal_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    check(spark, families(np.random.default_rng(5), 14) + EDGES[:10])


def test_other_similarity(spark):
    check(spark, families(np.random.default_rng(6), 6), percent=70)


def test_a_large_group_of_copies_costs_few_pairs(spark, monkeypatch):
    """700 near copies of one text at about the least similarity: rows grow with the group, not with its square."""
    rng, seen = np.random.default_rng(7), {}
    materialize = minhash.materialize

    def counted(df, name, *rest):
        out = materialize(df, name, *rest)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(minhash, "HOT", 300)
    base, rows = [f"b{k}" for k in range(300)], []
    for k in range(700):
        own = list(base)
        for place in rng.integers(0, 300, int(rng.integers(1, 5))):
            own[place] = f"c{k}x{place}"
        rows.append((k, " ".join(own)))
    check(spark, rows)
    assert sum(seen["minhash-pairs"]) + sum(seen["minhash-proposed"]) < 40 * 700 and max(seen["minhash-lists"]) < 30 * 700


def test_a_shared_passage_costs_few_pairs(spark, monkeypatch):
    """Documents of a common passage (half of each) are not compared with each other; a copy among them is found."""
    seen = []
    make = minhash._proposed
    monkeypatch.setattr(minhash, "_proposed", lambda *a: seen.append(make(*a)) or seen[-1])
    monkeypatch.setattr(minhash, "drop", lambda *a: None)
    monkeypatch.setattr(minhash, "HOT", 100)
    passage = [f"p{k}" for k in range(150)]
    rows = [(k, " ".join(passage + [f"o{k}x{j}" for j in range(150)])) for k in range(800)]
    rows += [(1000 + k, t.replace("x7 ", "x7y ")) for k, t in rows[::50]]
    check(spark, rows)
    assert sum(s.count() for s in seen) < 100


def test_chances():
    assert minhash.least_shared(85) == 191 and minhash.least_shared(100) == 256
    for percent in (70, 85, 95):
        for hot in range(65):
            c, h = minhash.index_size(64 - hot, hot, percent)
            foreign = (1 - percent / 100) * 64
            assert c <= 64 - hot and h <= hot
            assert (64 - hot > foreign and (foreign / (64 - hot)) ** c <= minhash.LOSS) or (c == 64 - hot and (hot == h or (foreign / hot) ** h <= minhash.LOSS))


def test_estimates_equal_plain_union_sketches():
    rng, least_ = np.random.default_rng(8), minhash.least_shared(85)
    for _ in range(300):
        whole = np.unique(rng.integers(0, 2**63, 800).astype(np.uint64))
        a, b = (np.sort(rng.choice(whole, int(rng.integers(2, 800)), replace=False)) for _ in range(2))
        if rng.random() < 0.7:
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], b[:3]]))
        least = np.sort(np.union1d(a, b))[: minhash.SKETCH]
        shared = len(np.intersect1d(np.intersect1d(a, b), least))
        found = minhash.agreement(a[:256], len(a), b[None, :256], np.array([min(len(b), 256)]), np.array([len(b)]), 85, minhash.least_shared(85))[0]
        if len(a) <= 256 and len(b) <= 256:
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert found == (exact if exact >= 0.85 else -1)
        else:
            assert found == (shared / 256 if shared >= least_ and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) else -1)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    found = sorted(tuple(r) for r in queries.QUERIES["op12_minhash_dedup"](spark, sf_dir).collect())
    assert found == sorted(brute(rows))
    assert any(not r[3] for r in found)
