"""Large groups and very common words: rows that are made follow the input, and results stay those of all rows."""

from collections import Counter

import numpy as np

import corpus_pipeline
from countershift.llm import bpe, lm, minhash, queries, simhash


def counting(monkeypatch, module, seen):
    """Rows of the tables that a module writes, by name."""
    materialize = module.materialize

    def counted(df, name, *rest):
        out = materialize(df, name, *rest)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "materialize", counted)


def test_near_copies_list_no_variants_for_each_document(spark, monkeypatch):
    rng, seen, n = np.random.default_rng(3), {}, 400
    base, rows = [f"b{k}" for k in range(200)], []
    for i in range(n):
        own = list(base)
        for place in rng.integers(0, 200, 2):
            own[place] = f"e{i}x{place}"
        rows.append((i, " ".join(own)))
    counting(monkeypatch, simhash, seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links, groups = simhash.similar_links(docs)
    assert links.count() >= n - 1
    assert {tuple(r) for r in groups.collect()} == {(i, 0) for i in range(n)}
    assert max(seen["near-members"]) <= 16 * n, seen


def test_hot_words_and_pairs_are_exact(spark, monkeypatch):
    """Pairs are counted of hot words alone; words and pairs are those of the whole sample."""
    monkeypatch.setattr(lm, "SAMPLED", 1)
    monkeypatch.setattr(lm, "MAX_HOT", 50)
    rng, seen = np.random.default_rng(4), {}
    texts = [" ".join("the" if rng.random() < 0.2 else "of" if rng.random() < 0.1 else f"w{rng.integers(0, 3000)}" for _ in range(60)) for _ in range(200)]
    counting(monkeypatch, lm, seen)
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    hot, total = lm._hot_words(docs.selectExpr("doc_id", "cast(text as binary) as text"))
    words, pairs = Counter(), Counter()
    for t in [*texts, ""]:
        own = ["", *t.split(), ""]
        words.update(own[1:])
        pairs.update(zip(own[1:], own[:-1]))
    assert total == sum(words.values())
    assert seen["lm-frequent"] == [len(words)]  # no pair of rare words is among them
    code = lambda w: int(lm._hash([w.encode()])[0])
    assert {*hot.words.tolist()} == {code(w) for w, n in words.items() if n * 50 > total} | {code("")}
    found = set(zip(hot.pair_word.tolist(), hot.pair_context.tolist()))
    assert found == {(code(w), code(c)) for (w, c), n in pairs.items() if n * 50 > total} and found


def test_lists_of_hot_values_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 20)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{passage} " + " ".join(f"o{i}x{k}" for k in range(40))) for i in range(60)]
    found = minhash._sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
    nodes = minhash.materialize(found.selectExpr("doc_id as node", "doc_id", "text_key", "n", "sketch"), "nodes")
    materialize, plans = minhash.materialize, {}

    def kept(df, name, *rest):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name, *rest)

    monkeypatch.setattr(minhash, "materialize", kept)
    lists = {tuple(r) for r in minhash._lists(nodes, 85).collect()}
    assert "Join" not in plans["minhash-lists"]
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    assert lists == {tuple(r) for r in minhash._lists(nodes, 85).collect()}
    assert "Join" in plans["minhash-lists"]


def test_near_dedup_makes_no_rows_for_unrelated_texts(spark, monkeypatch):
    """Fingerprints of few bits meet by chance, with the square of the number of texts; near_dedup pairs what shares a shingle, and misses no copy."""
    seen, n = {}, 5000
    rows = [(i, " ".join(f"o{i}x{k}" for k in range(40))) for i in range(n)]
    long = [[f"l{i}x{k}" for k in range(400)] for i in range(40)]
    rows += [(n + i, " ".join(w)) for i, w in enumerate(long)]
    rows += [(n + 40 + i, " ".join(x if k % 48 else f"c{i}x{k}" for k, x in enumerate(w))) for i, w in enumerate(long)]  # similarity 0.81
    for module in (simhash, minhash):
        counting(monkeypatch, module, seen)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(n + 40))
    assert sum(seen.get("near-variants", [])) + sum(seen.get("minhash-pairs", [])) <= 80, seen
    assert set(seen["minhash-nodes"]) == {80}


def test_sketches_are_kept_of_nodes_that_share_a_value_alone(spark, monkeypatch):
    """Texts like no other need no sketch after the lists are made; the copies among them are found all the same."""
    seen, n = {}, 200
    rows = [(i, " ".join(f"o{i}x{k}" for k in range(300))) for i in range(n)]
    rows += [(n + i, rows[i][1].replace("x100 ", "x100y ")) for i in range(5)]
    counting(monkeypatch, minhash, seen)
    found = minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i % n) for i, _ in rows}
    assert seen["minhash-nodes"] == [10] and seen["minhash-sets"] == [n + 5], seen


def test_only_reached_places_of_a_word_are_looked_at():
    v, walks = bpe.codec(queries.TOKENIZER).vocabulary, [0]

    class Root(dict):
        def __getitem__(self, c):
            walks[0] += 1
            return super().__getitem__(c)

    root = v.root
    v.root = Root(root)
    try:
        rng = np.random.default_rng(5)
        for _ in range(50):
            word = "".join(rng.choice(list("abcdeinrst"), 40))
            walks[0] = 0
            ids = v.encode_symbols(word[:-1] + chr(256 + ord(word[-1])))
            assert sum(v.length[i] for i in ids) == 40
            assert walks[0] < 40
    finally:
        v.root = root
