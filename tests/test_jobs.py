"""The jobs: growing input, reruns, killed batches, nulls, command lines, and their SQL."""

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from countershift.operators import cells
from jobs import length_gap, order_gap, registered

DOCS = "doc_id long, text string, lang string, source string, n long, y long, w double"


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def report_of(spark, done):
    return rows_of(spark.read.schema(length_gap.REPORT).parquet(done["report"]))


def plain_report(rows, reference="en", probs=(0.1, 0.25, 0.5, 0.75, 0.9)):
    """The report by sorting whole distributions."""
    held = {}
    for text, lang, source in rows:
        held.setdefault(lang or "", {}).setdefault(source or "", []).append(len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    out = []
    for lang in held:
        both = [s for s in held[lang] if s in held.get(reference, {})]
        if lang == reference or not both:
            continue
        sides = [{s: np.array(held[x][s], float) for s in both} for x in (reference, lang)]
        total = [sum(map(len, x.values())) for x in sides]
        levels = []
        for base, weight in ((0, lambda s: 1 / total[0]), (0, lambda s: len(sides[1][s]) / len(sides[0][s]) / total[1]), (1, lambda s: 1 / total[1])):
            v, w = np.concatenate([sides[base][s] for s in both]), np.concatenate([np.full(len(sides[base][s]), weight(s)) for s in both])
            order = np.argsort(v, kind="stable")
            v, running = v[order], np.cumsum(w[order])
            steps = {x: round(float(running[np.flatnonzero(v == x)[-1]]), 12) for x in np.unique(v)}
            levels.append({"mean": float((np.sort(v) * w[order]).sum())} | {f"q{p}": min([x for x, f in steps.items() if f >= p], default=v[-1]) for p in probs})
        for m in levels[0]:
            a, b, c = (x[m] for x in levels)
            out += [(lang, e, m, x, total[0], total[1]) for e, x in (("structure", c - b), ("composition", b - a), ("total", c - a))]
    return {(k[0] or None, *k[1:3]): k[3:] for k in out}


def same(found, expected):
    got = {(r["lang"], r["effect"], r["measure"]): (r["estimate"], r["reference_docs"], r["documents"]) for r in found}
    assert set(got) == set(expected)
    for k, x in expected.items():
        assert got[k][0] == pytest.approx(x[0], abs=2e-6) and got[k][1:] == x[1:]


@pytest.fixture()
def parts(spark, sf_dir):
    """The documents in four parts, with nulls, a language of its own source, and a repeated row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = [(-1, None, "fr", "src1"), (-2, "", None, "src2"), (-3, "two words", "en", None), (-4, "x", "fr", None), (-5, "alone here", "xx", "nowhere"), (-6, "same row", "de", "src3"), (-6, "same row", "de", "src3")]
    every = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")).selectExpr("*", "1L AS words", "'k' AS batch", "0 AS d")
    return [every.where(F.pmod("doc_id", F.lit(4)) == k) for k in range(4)]


def test_many_runs_over_a_growing_folder_equal_one(spark, parts, tmp_path):
    folder, out, check = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "check")
    read, seen = [], []
    for k, part in enumerate(parts):
        part.repartition(2).write.mode("append").parquet(folder)
        done = length_gap.run(spark, folder, out, check)
        read.append(done["read"])
        if k == 1:  # nothing new: nothing read, nothing changed
            before = report_of(spark, done)
            files = sorted(p.relative_to(out) for p in Path(out, "counts").rglob("*.parquet"))
            again = length_gap.run(spark, folder, out, check)
            assert again["read"] == 0 and report_of(spark, again) == before and sorted(p.relative_to(out) for p in Path(out, "counts").rglob("*.parquet")) == files
        seen.append(report_of(spark, done))
    assert read == [p.count() for p in parts] and len({json.dumps(s) for s in seen}) == 4
    once = length_gap.run(spark, folder, str(tmp_path / "once"), str(tmp_path / "once-check"), length_gap.read_config() | {"files_per_batch": 3})
    assert seen[-1] == report_of(spark, once)
    rows = [(r["text"], r["lang"], r["source"]) for p in parts for r in p.collect()]
    same(spark.read.schema(length_gap.REPORT).parquet(done["report"]).collect(), plain_report(rows))
    assert not any(r["lang"] == "xx" for r in spark.read.parquet(done["report"]).collect())


def test_a_killed_batch_is_taken_again(spark, parts, tmp_path, monkeypatch):
    folder, out, check = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in parts[:2]:
        part.repartition(2).write.mode("append").parquet(folder)
    config = length_gap.read_config() | {"files_per_batch": 1}
    info, lost = length_gap.log.info, []

    def dies(message, *args):
        info(message, *args)
        if message.startswith("batch") and args[0] == 1 and not lost:
            lost.append(args)
            raise RuntimeError("lost after its table was written")

    monkeypatch.setattr(length_gap.log, "info", dies)
    with pytest.raises(Exception, match="lost after"):
        length_gap.run(spark, folder, out, check, config)
    done = length_gap.run(spark, folder, out, check, config)
    fresh = length_gap.run(spark, folder, str(tmp_path / "fresh"), str(tmp_path / "fresh-check"), config)
    assert lost and report_of(spark, done) == report_of(spark, fresh)


def test_no_documents_and_no_reference(spark, parts, tmp_path):
    folder = str(tmp_path / "docs")
    parts[0].where("false").write.parquet(folder)
    done = length_gap.run(spark, folder, str(tmp_path / "out"), str(tmp_path / "check"))
    assert done["read"] == done["written"] == 0
    parts[0].where("lang <> 'en'").write.mode("append").parquet(folder)
    done = length_gap.run(spark, folder, str(tmp_path / "out"), str(tmp_path / "check"))
    assert done["read"] > 0 and done["written"] == 0


def test_settings_stay(spark, parts, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    parts[0].write.parquet(str(tmp_path / "docs"))
    length_gap.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert before == {k: spark.conf.get(k, None) for k in before} and not spark.streams.active


@pytest.mark.parametrize("name", ["job1_length_gap", "job2_order_gap"])
def test_registered_jobs_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = registered.QUERIES[name](spark, sf_dir).toPandas()
    expected = con.execute(registered.ORACLE_SQL[name]).df()
    keys = [c for c in sorted(found.columns) if found[c].dtype == object or str(found[c].dtype).startswith("str")]
    a, b = (t[sorted(t.columns)].sort_values(keys).reset_index(drop=True) for t in (found, expected))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a.columns:
        assert (a[c] == b[c]).all() if c in keys else np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6)


def test_order_gap_reruns_and_nulls(spark, tmp_path):
    rng = np.random.default_rng(1)
    orders = [(k, int(rng.integers(0, 30)), float(rng.normal(200_000, 60_000)), f"199{int(rng.integers(5, 10))}-05-01 00:00:00", [None, "1", "2"][int(rng.integers(0, 3))], "x") for k in range(3000)]
    orders += [(5000, 3, None, "1996-01-01 00:00:00", "1", "x"), (5001, 3, 1.0, None, "1", "x"), (5002, 999, 1.0, "1996-01-01 00:00:00", "1", "x"), (5003, 3, float("nan"), "1996-01-01 00:00:00", "1", "x"), (5004, None, 1.0, "1996-01-01 00:00:00", "1", "x")]
    frame = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, d string, o_orderpriority string, segment string").withColumn("o_orderdate", F.to_timestamp("d"))
    customers = [(k, f"s{k % 2}" if k % 7 else None, k % 3) for k in range(30)]
    paths = [str(tmp_path / t) for t in ("orders", "customers", "nations")]
    for path, df in zip(paths, (frame, spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey long"), spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "n_nationkey long, n_regionkey long"))):
        df.write.parquet(path)
    first = order_gap.run(spark, *paths, str(tmp_path / "out"))
    found = rows_of(spark.read.schema(order_gap.REPORT).parquet(first["report"]))
    assert rows_of(spark.read.schema(order_gap.REPORT).parquet(order_gap.run(spark, *paths, str(tmp_path / "out"))["report"])) == found
    held = {}
    for k, c, y, d, p, _ in orders[:3000]:
        held.setdefault(("" if c % 7 == 0 else f"s{c % 2}", int(d >= "1998-04-01")), {}).setdefault((p, {0: 0, 1: 1, 2: 0}[c % 3]), []).append(y)
    got = {(r["segment"], r["effect"]): r["estimate"] for r in spark.read.schema(order_gap.REPORT).parquet(first["report"]).where("measure = 'up to 200000'").collect()}
    for s in ("", "s0", "s1"):
        a, b = ({c: np.array(v) <= 200_000 for c, v in held[s, g].items()} for g in (0, 1))
        both = sorted(set(a) & set(b), key=str)
        n0, n1 = (sum(len(x[c]) for c in both) for x in (a, b))
        levels = sum(a[c].sum() for c in both) / n0, sum(a[c].mean() * len(b[c]) for c in both) / n1, sum(b[c].sum() for c in both) / n1
        for e, x in (("structure", levels[2] - levels[1]), ("composition", levels[1] - levels[0]), ("total", levels[2] - levels[0])):
            assert got[s or None, e] == pytest.approx(x, abs=2e-6)
    none = order_gap.run(spark, *paths, str(tmp_path / "none"), order_gap.read_config() | {"cutoff": "2030-01-01"})
    assert none["written"] == 0


def test_command_lines(sf_dir, tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    root = Path(__file__).parent.parent
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"reference": "de", "probs": [0.5], "files_per_batch": 1}))
    for args in (
        ["jobs.length_gap", "--documents", f"{sf_dir}/documents.parquet", "--output", f"{tmp_path}/a", "--checkpoint", f"{tmp_path}/c", "--config", str(config)],
        ["jobs.order_gap", "--orders", f"{sf_dir}/orders.parquet", "--customers", f"{sf_dir}/customer.parquet", "--nations", f"{sf_dir}/nation.parquet", "--output", f"{tmp_path}/b"],
    ):
        done = subprocess.run([sys.executable, "-m", *args], capture_output=True, text=True, env=env, cwd=root, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        said = json.loads(done.stdout.strip().splitlines()[-1])
        assert said["written"] > 0 and "read" in done.stderr and "wrote" in done.stderr
    assert sorted(p.name for p in (tmp_path / "a" / "report").iterdir() if p.is_dir()) == ["lang=en", "lang=es", "lang=fr"]


def test_cells_keep_common_support(spark):
    rows = [("k", 0, "a", 1.0, 2.0), ("k", 0, "b", 5.0, 1.0), ("k", 1, "a", 3.0, 1.0), ("k", 1, "c", 9.0, 1.0), ("j", 0, "a", 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "key string, g int, cell string, y double, w double")
    share = cells.supported(frame, ["key"]).collect()
    assert [(r["key"], r["cell"], r["w0_"], r["w1_"], r["t0_"], r["t1_"]) for r in share] == [("k", "a", 2.0, 1.0, 2.0, 1.0)]
    found = cells.distribution_quantiles(frame, ["key"], "y", [0.5]).collect()
    assert sorted((r["d"], r["q"]) for r in found) == [(0, 1.0), (1, 1.0), (2, 3.0)]
