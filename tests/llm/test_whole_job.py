"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest

from countershift.llm import bpe, chat, licenses, lm, queries, simhash
from countershift.llm.tokens import word_encoder


def test_lm_contexts_are_words(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 300, 200))) for i in range(200)]
    rows = lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    out = rows[rows.held_out]
    # of two tokens one is drawn from 300 and the word before tells the other: 1.24 each and a little for smoothing
    assert len(out) and -1.35 < out.score.sum() / out.n_tokens.sum() < -1.2


def test_lm_scores_do_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = (lm.score_documents(docs.repartition(n)).toPandas().sort_values("doc_id", ignore_index=True) for n in (2, 7))
    assert np.allclose(one.score, two.score, rtol=1e-9) and np.allclose(one.base_score, two.base_score, rtol=1e-9)
    found = {r["held_out"]: r for r in lm.perplexity(lm.score_documents(docs)).collect()}
    held = one[one.held_out]
    assert found[True]["documents"] == len(held)
    assert np.isclose(found[True]["perplexity"], 10 ** (-held.score.sum() / held.n_tokens.sum()), rtol=1e-9)
    assert found[True]["perplexity"] < found[True]["base_perplexity"]


@pytest.mark.parametrize("discount", [0.1, 0.3, 0.5, 0.7, 0.9])
def test_large_dishes_are_drawn_from_their_conditional(discount):
    """Draws beyond ``EXACT`` against the recursion, at sizes where both can be had."""
    size = 1500
    table = np.full(size + 1, -np.inf)
    table[1] = 0.0
    for n in range(1, size):
        t = np.arange(1, n + 2)
        table[1 : n + 2] = np.logaddexp(table[:-1][t - 1], np.log(np.maximum(n - t * discount, 1e-300)) + np.where(t <= n, table[t], -np.inf))
    t = np.arange(1, size + 1)
    assert np.abs(lm.log_stirling_large(discount, np.full(size, size), t) - table[1:]).max() < 0.12
    for p, others in ((1e-6, 10), (1e-3, 1000), (0.01, 10**6), (0.3, 100)):
        logs = np.cumsum(np.log((lm.CONCENTRATION + discount * (others + t - 1)) * p)) + table[1:]
        weights = np.exp(logs - logs.max())
        weights /= weights.sum()
        mean = (t * weights).sum()
        spread = np.sqrt(((t - mean) ** 2 * weights).sum())
        drawn = lm.draw_tables(np.full(4000, size), np.full(4000, others), np.full(4000, p), discount, np.random.default_rng(2))
        assert abs(drawn.mean() - mean) < 0.01 * mean + 0.08 * spread
        assert abs(drawn.std() - spread) < 0.08 * spread + 0.02


def spans(text):
    index = licenses.Index(licenses.TEMPLATES)
    return [(m[0], m[3], m[4]) for m in licenses.scan_text(index, text.encode(), 0.8)]


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"])
@pytest.mark.parametrize("times", [2, 100])
def test_license_repeats_give_a_row_each(name, times):
    text = licenses.TEMPLATES[name] + ". "
    n = len(licenses.words(text.encode()))
    assert [m[1:] for m in spans(text * times) if m[0] == name] == [(k * n, k * n + n) for k in range(times)]


def test_edited_short_licenses_are_candidates():
    for text in ("Released under the terms of the MIT License", "Released under the permissive MIT License", "Released under MIT License"):
        assert [m[0] for m in spans("some words before " + text + " and behind")] == ["MIT"]
    assert "Apache-2.0" in [m[0] for m in spans("Licensed under the Apache Licence, Version 2.0")]
    # every template with any words left out that the coverage allows
    rng, index = np.random.default_rng(0), licenses.Index(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        ws = licenses.words(template.encode())
        for _ in range(20):
            gone = rng.choice(len(ws), int(len(ws) * 0.2 + 1e-9), replace=False)
            text = b" ".join(b"other" if k in gone else w for k, w in enumerate(ws))
            t = index.names.index(name)
            assert any(c[0] == t and index.matches(index.ids(text), *c) for c in index.candidates(index.ids(text)))


def test_sketches_count_a_shingle_once():
    body, line = " ".join(f"w{k}" for k in range(300)), " ".join(f"x{k}" for k in range(14)) + " "
    few, many = (simhash.sketch(simhash.shingle_set(f"{body} {line * n}", 3)).tolist() for n in (2, 100))
    assert few == many


def test_chat_answers_stand_with_their_prompts(spark):
    rng = np.random.default_rng(5)
    turns = []
    for conv in range(12):
        turns.append((conv, 0, "system", "be brief"))
        for k in range(1, 25):
            turns.append((conv, k, "user" if k % 2 else "assistant", f"c{conv}t{k} " + " ".join(["word"] * int(rng.choice([5, 60, 250, 500])))))
    rows = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), queries.TOKENIZER).collect()
    encoder = word_encoder(queries.TOKENIZER)
    size = lambda role, text: len(encoder.ids(chat.format_turn(role, text)[0].encode())) // 4
    text_of = {(c, k): (r, t) for c, k, r, t in turns}
    trained = []
    for row in rows:
        held = chat.read_turns(row["text"])
        assert row["tokens"] <= 1024 and row["tokens"] == sum(size(*t) for t in held)
        marks = [t.split()[0] for _, t in held]
        for (role, text), mark in list(zip(held, marks))[row["repeated"] :]:
            if role == "assistant":
                k = int(mark.split("t")[1])
                trained.append((row["conv_id"], k))
                pair = [text_of[row["conv_id"], j] for j in (0, k - 1, k)]
                if sum(size(*t) for t in pair) <= 1024:
                    assert f"c{row['conv_id']}t{k - 1}" in marks
    assert sorted(trained) == [(c, k) for c in range(12) for k in range(2, 25, 2)]


def test_sketches_equal_brute_force():
    for n in (0, 1, 5, 63, 64, 500):
        hashes = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = (simhash._mixed(hashes[None] + simhash._STEPS)[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        expected = [sum(1 << b for b in range(64) if row[:, b].sum() * 2 > n) for row in bits]
        assert [int(x) % (1 << 64) for x in simhash.sketch(hashes)] == expected


def test_near_copies_at_the_least_similarity_are_found(spark):
    """10,000 pairs of five-word similarity 0.802, edited in one place, which is the hardest kind for three-word sketches."""
    rng, n = np.random.default_rng(11), 10_000
    rows = []
    for k in range(n):
        ws = [f"w{x}" for x in rng.integers(0, 20_000, 150)]
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(ws[:-16] + [f"z{k}x{j}" for j in range(16)]))]
    assert simhash.recall(0.802) > 0.92
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links, groups = simhash.similar_links(docs)
    found = {(r["a"], r["b"]) for r in links.collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(n)} and len(found) >= 0.9 * n


def test_unlike_documents_between_copies_hide_none(spark):
    """Documents that share a passage (similarity 0.6 each) collide in many variants; copies among them are all found."""
    rng = np.random.default_rng(13)
    passage, rows = [f"p{k}" for k in range(380)], []
    for k in range(400):
        own = passage + [f"o{k}x{j}" for j in range(120)]
        rows.append((k, " ".join(own)))
        if k >= 200:
            own[int(rng.integers(0, 500))] = f"changed{k}"
            rows.append((1000 + k, " ".join(own)))
    links, groups = simhash.similar_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r["node"], r["component"]) for r in groups.collect() if r["node"] != r["component"]} == {(1000 + k, k) for k in range(200, 400)}


@pytest.mark.parametrize("chunks", [1, 3])
def test_links_within_a_group_equal_brute_force(chunks):
    rng = np.random.default_rng(chunks)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))) if k % 3 else np.setdiff1d(np.arange(30), rng.integers(0, 30, 3)) for k in range(80)]
    at = np.arange(80) % chunks
    found = []
    for i in range(chunks):
        for j in range(i, chunks):
            own = sorted((k for k in range(80) if at[k] in (i, j)), key=lambda k: at[k])
            found += [(own[x], own[y]) for x, y in simhash.links_within([sets[k] for k in own], 0.8, at[own])]
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    assert all(alike(sets[a], sets[b]) for a, b in found)

    def groups(pairs):
        label = list(range(80))
        for a, b in pairs:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        return label

    assert groups(found) == groups([(a, b) for a in range(80) for b in range(a) if alike(sets[a], sets[b])])


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    rng, seen = np.random.default_rng(17), {}
    materialize = simhash.materialize

    def counted(df, name, *rest):
        out = materialize(df, name, *rest)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "UNIT_SHINGLES", 40_000)  # several chunks
    base, rows = [f"b{k}" for k in range(300)], []
    for k in range(600):
        own = list(base)
        for place in rng.integers(0, 300, int(rng.integers(1, 9))):
            own[place] = f"c{k}x{place}"
        rows.append((k, " ".join(own)))
    _, groups = simhash.similar_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sets = {k: set(simhash.shingle_set(t, 5).tolist()) for k, t in rows}
    label = {k: k for k in sets}
    for a in range(600):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = {k: min(label[a], label[b]) if x in (label[a], label[b]) else x for k, x in label.items()}
    assert {r["node"]: r["component"] for r in groups.collect()} == {k: x for k, x in label.items() if sum(v == x for v in label.values()) > 1}
    assert seen["near-pairs"] + seen["near-open"] + seen["near-verified"] < 600 * 600 / 8


def test_chat_windows_are_full_and_hold_history():
    rng = np.random.default_rng(3)
    for _ in range(300):
        tokens, budget, history = rng.integers(1, int(rng.choice([10, 60, 150])), int(rng.integers(1, 200))).tolist(), 100, int(rng.choice([0, 20, 50]))
        first = int(rng.integers(0, min(3, len(tokens))))
        found = chat.spans(tokens, first, budget, history)
        assert [x for _, a, b in found for x in range(a, b)] == list(range(first, len(tokens)))
        for begin, a, b in found:
            size = sum(tokens[begin:b])
            assert size <= budget or (begin, b) == (a, a + 1)
            assert b == len(tokens) or size + tokens[b] > budget  # no further turn fits
            if a:
                prompt = tokens[a - 1] + tokens[a] <= budget
                assert (begin < a) == prompt if tokens[a - 1] > history else begin < a or not prompt
            # one turn more of history is over the allowance or leaves no room for the first turn
            assert begin == 0 or sum(tokens[begin - 1 : a]) > history or sum(tokens[begin - 1 : a + 1]) > budget


def test_chat_query_keeps_every_turn(spark, sf_dir):
    import hashlib

    import pandas as pd

    turns = pd.read_parquet(f"{sf_dir}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    turns = pd.concat([turns, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})])
    found = {r["conv_id"]: r for r in queries.QUERIES["op3_chat_formatting"](spark, sf_dir).collect()}
    assert set(found) == set(turns.conv_id)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, rows in turns.sort_values("turn").groupby("conv_id"):
        texts = [t or "" for t in rows.text]
        loss = "".join(t for r, t in zip(rows.role, texts) if r == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(rows), sha("".join(f"{a}\n{t}\n" for a, t in zip(rows.role, texts))))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    windows = chat.windows(spark.createDataFrame(turns.astype({"conv_id": "int64"})[["conv_id", "turn", "role", "text"]]), queries.TOKENIZER).toPandas()
    assert windows.groupby("conv_id").text.apply(lambda t: sum(map(len, t))).to_dict() == {c: r["formatted_chars"] for c, r in found.items()}
    full = windows.sort_values("window").groupby("conv_id").apply(lambda w: w.iloc[:-1], include_groups=False)
    if len(full):
        assert (full.tokens / 1024).mean() > 0.7


def test_chat_segments_join_up(spark, monkeypatch):
    """Windows over segment borders: turns in order, once each, with history from the segment before."""
    monkeypatch.setattr(chat, "SEGMENT", 2)
    rng = np.random.default_rng(8)
    turns = [(c, 0, "system", "be brief") for c in (1, 2)] + [(c, k, "user" if k % 2 else "assistant", f"c{c}t{k} " + "word " * int(rng.choice([3, 40, 120, 700]))) for c in (1, 2, None) for k in range(1, 120)]
    rows = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5), queries.TOKENIZER, budget=256, history=64).toPandas()
    text_of = {(c, k): t for c, k, _, t in turns}
    sizes = word_encoder(queries.TOKENIZER)
    size = lambda role, text: len(sizes.ids(chat.format_turn(role, text)[0].encode())) // 4
    for c in (1, 2, None):
        seen, own = [], rows[rows.conv_id.isna() if c is None else rows.conv_id == c].sort_values("window")
        assert len(own) > 20
        for number, row in enumerate(own.itertuples()):
            held = chat.read_turns(row.text)
            system = int(c is not None)
            assert held[0][0] == "system" if system else True
            marks = [int(t.split()[0].split("t")[1]) for _, t in held[system:]]
            assert marks == list(range(marks[0], marks[0] + len(marks)))
            new = marks[row.repeated - (system if number else 0) :]
            if new[0] > 1:
                pair = [size("user" if k % 2 else "assistant", text_of[c, k]) for k in (new[0] - 1, new[0])]
                assert (new[0] - 1 in marks) == (sum(pair) + (size("system", "be brief") if system else 0) <= 256)
            seen += new
        assert seen == list(range(1, 120))


@pytest.mark.parametrize("window", [3, 16, 1 << 16])
def test_long_words_equal_the_library(monkeypatch, window):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "WINDOW", window)
    rng, library, codec = np.random.default_rng(window), Tokenizer.from_file(queries.TOKENIZER), bpe.Codec(queries.TOKENIZER)
    texts = ["".join(rng.choice(list("abcdeinrst"), int(n))) for n in (1, 2, 15, 40, 500, 5000)] + ["ab" * 1000, "a" * 2001, "the" * 900]
    if window > 16:
        texts.append("".join(rng.choice(list("abcdeinrst"), 200_000)))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        found = codec.encode(text.encode())
        assert np.frombuffer(found, np.uint32).tolist() == ids
        assert codec.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_scan_finds_what_alignment_at_every_place_finds(monkeypatch):
    """Matches whose words are shifted against each other by ``BAND`` at most, wherever they stand."""
    rng, index = np.random.default_rng(21), licenses.Index(licenses.TEMPLATES)
    short = [t for t, ids in enumerate(index.templates) if len(ids) <= 15]
    seen = 0
    for _ in range(60):
        ws = []
        for _ in range(int(rng.integers(1, 4))):
            ws += [f"noise{rng.integers(0, 9)}" for _ in range(int(rng.integers(0, 12)))]
            own = licenses.words(licenses.TEMPLATES[index.names[int(rng.choice(short))]].encode())
            own = [w.decode() for w in own if rng.random() > 0.12]
            for _ in range(int(rng.integers(0, 4))):
                own.insert(int(rng.integers(0, len(own) + 1)), str(rng.choice(["acme", "the", "license", "under"])))
            ws += own
        ids = index.ids(" ".join(ws).encode())
        with monkeypatch.context() as m:
            m.setattr(licenses, "BAND", licenses.BAND // 2)
            every = {t for t in short for d in range(-len(index.templates[t]), len(ids)) if index.align(ids, t, d, d)[0] >= index.least[t]}
        found = {c[0] for c in index.candidates(ids) if index.matches(ids, *c)}
        assert every <= found
        seen += len(every)
    assert seen > 40


def test_lm_scores_equal_a_plain_sampler(spark):
    """Scores of a toy corpus against a sampler that draws one table count after the other and averages many sweeps."""
    rng = np.random.default_rng(9)
    chain = rng.dirichlet(np.full(14, 0.3), 15)
    docs = []
    for i in range(150):
        at, ws = 14, []
        for _ in range(int(rng.integers(3, 40))):
            at = int(rng.choice(14, p=chain[at]))
            ws.append(f"w{at}")
        docs.append((i, " ".join(ws)))
    rows = lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), sweeps=10, samples=60).toPandas().set_index("doc_id")

    pairs = {}
    for i, text in docs:
        if not rows.held_out[i]:
            ws = ["", *text.split(), ""]
            for u, w in zip(ws, ws[1:]):
                pairs[u, w] = pairs.get((u, w), 0) + 1
    words = sorted({w for _, w in pairs})
    share = lambda values: min(max(sum(v == 1 for v in values) / max(sum(v == 1 for v in values) + 2 * sum(v == 2 for v in values), 1e-9), 0.1), 0.9)
    tables = dict.fromkeys(pairs, 1)
    parent = {w: sum(x == w for _, x in pairs) for w in words}
    d, e, base = share(list(pairs.values())), share(list(parent.values())), 1 / (len(words) + 1)
    top = dict.fromkeys(words, 1)

    def drawn(n, others, p, discount):
        t = np.arange(1, n + 1)
        logs = np.cumsum(np.log((1 + discount * (others + t - 1)) * p)) + np.array([stirling(discount, n, k) for k in t])
        weights = np.exp(logs - logs.max())
        return int(rng.choice(t, p=weights / weights.sum()))

    known = {}

    def stirling(discount, n, t):
        if (discount, n) not in known:
            row = {1: 0.0}
            for m in range(1, n):
                row = {k: np.logaddexp(row.get(k - 1, -np.inf), np.log(m - k * discount) + row[k] if k in row else -np.inf) for k in range(1, m + 2)}
            known[discount, n] = row
        return known[discount, n][t]

    def parent_probability(c, t, total, all_tables):
        return (c - e * t + (1 + e * all_tables) * base) / (1 + total)

    mean, count = dict.fromkeys(pairs, 0.0), 0
    unseen = {u: 0.0 for u in {u for u, _ in pairs}}
    lone = dict.fromkeys([*words, None], 0.0)
    for sweep in range(140):
        for (u, w), n in pairs.items():
            if n > 1:
                others = parent[w] - tables[u, w]
                p = parent_probability(others, min(top[w], others), sum(parent.values()) - tables[u, w], sum(top.values()))
                new = drawn(n, sum(t for (v, _), t in tables.items() if v == u) - tables[u, w], p, d)
                parent[w] += new - tables[u, w]
                tables[u, w] = new
        for w in words:
            top[w] = min(top[w], parent[w])
            if parent[w] > 1:
                top[w] = drawn(parent[w], sum(top.values()) - top[w], base, e)
        if sweep >= 40:
            count += 1
            total, all_tables = sum(parent.values()), sum(top.values())
            at = {w: parent_probability(parent[w], top[w], total, all_tables) for w in words} | {None: parent_probability(0, 0, total, all_tables)}
            for w, p in at.items():
                lone[w] += p
            for u in unseen:
                own = [(n, tables[u, w]) for (v, w), n in pairs.items() if v == u]
                customers, seated = sum(n for n, _ in own), sum(t for _, t in own)
                unseen[u] += (1 + d * seated) / (1 + customers)
                for (v, w), n in pairs.items():
                    if v == u:
                        mean[u, w] += (n - d * tables[u, w] + (1 + d * seated) * at[w]) / (1 + customers)
    for i, text in docs:
        ws, score = ["", *text.split(), ""], 0.0
        for u, w in zip(ws, ws[1:]):
            if (u, w) in mean:
                score += np.log10(mean[u, w] / count)
            else:
                back = lone.get(w, lone[None]) / count
                score += np.log10(back * (unseen[u] / count if u in unseen else 1.0))
        assert abs(score - rows.score[i]) < 0.02 * len(ws) + 0.05
    assert rows.score.mean() > rows.base_score.mean()


def test_spans_of_many_notices_are_those_of_the_text():
    """Hundreds of notices among characters of several bytes: a row each, whose code points hold its words."""
    name = min(licenses.TEMPLATES, key=lambda n: (len(licenses.TEMPLATES[n].split()) < 12, len(licenses.TEMPLATES[n])))
    notice = licenses.TEMPLATES[name]
    text = "\n".join(f"é{k} 中文 x{k} {notice} 👍🏽 ẛ̣{k}" for k in range(300))
    found = [m for m in licenses.scan_text(licenses.Index(licenses.TEMPLATES), text.encode(), 0.8) if m[0] == name]
    assert len(found) == 300
    for _, _, coverage, first, end, start, stop in found:
        assert coverage == 1 and text[start:stop].split() == notice.split() == text.split()[first:end]
