"""The jobs as registered queries: each runs twice into one new folder and returns what stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countershift.functions.curves import normal_quantile
from countershift.queries import mixing_rounds_sql
from countershift.sources.sinks import shared_folder
from jobs import length_gap, order_gap


def job1_length_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = shared_folder(spark, "job1")
    for _ in range(2):
        done = length_gap.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(length_gap.REPORT).parquet(done["report"])


def job2_order_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = shared_folder(spark, "job2")
    for _ in range(2):
        done = order_gap.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "nation")), f"{folder}/out")
    return spark.read.schema(order_gap.REPORT).parquet(done["report"])


def length_gap_sql(reference: str, probs: list[float]) -> str:
    values = ", ".join(f"(CAST({p!r} AS DOUBLE))" for p in probs)
    return rf"""
        WITH d AS (
          SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS cell, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS y FROM documents),
        c AS (SELECT lang, cell, y, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL),
        s AS (
          SELECT o.lang, o.cell, o.w AS w1, r.w AS w0, sum(o.w) OVER (PARTITION BY o.lang) AS t1, sum(r.w) OVER (PARTITION BY o.lang) AS t0
          FROM (SELECT lang, cell, sum(n) AS w FROM c WHERE lang <> '{reference}' GROUP BY ALL) o JOIN (SELECT cell, sum(n) AS w FROM c WHERE lang = '{reference}' GROUP BY ALL) r ON r.cell = o.cell),
        m AS (
          SELECT s.lang, k.d, c.y, sum(c.n * CASE k.d WHEN 0 THEN 1 / t0 ELSE w1 / w0 / t1 END) AS m FROM c JOIN s ON s.cell = c.cell, (VALUES (0), (1)) k(d) WHERE c.lang = '{reference}' GROUP BY ALL
          UNION ALL SELECT s.lang, 2, c.y, sum(c.n / t1) FROM c JOIN s ON s.cell = c.cell AND s.lang = c.lang GROUP BY ALL),
        f AS (SELECT *, round(sum(m) OVER (PARTITION BY lang, d ORDER BY y), 12) AS f FROM m),
        l AS (
          SELECT lang, d, 'q' || CAST(p AS VARCHAR) AS measure, CAST(coalesce(min(y) FILTER (f >= p), max(y)) AS DOUBLE) AS v FROM f, (VALUES {values}) q(p) GROUP BY lang, d, p
          UNION ALL SELECT lang, d, 'mean', sum(m * y) FROM m GROUP BY lang, d),
        w AS (SELECT lang, measure, max(v) FILTER (d = 0) AS l0, max(v) FILTER (d = 1) AS l1, max(v) FILTER (d = 2) AS l2 FROM l GROUP BY ALL),
        e AS (SELECT lang, measure, unnest(['structure', 'composition', 'total']) AS effect, unnest([l2 - l1, l1 - l0, l2 - l0]) AS estimate FROM w)
        SELECT effect, measure, round(estimate, 6) + 0 AS estimate, reference_docs, documents, nullif(e.lang, '') AS lang
        FROM e JOIN (SELECT lang, CAST(any_value(t0) AS BIGINT) AS reference_docs, CAST(any_value(t1) AS BIGINT) AS documents FROM s GROUP BY lang) t ON t.lang = e.lang
    """


def order_gap_sql(config: dict) -> str:
    thresholds, alpha = config["thresholds"], config["alpha"]
    names = ["mean", *(f"up to {t:g}" for t in thresholds)]
    sums = ", ".join(["sum(w * y) AS m0", *(f"sum(CASE WHEN y <= {float(t)!r} THEN w ELSE 0 END) AS m{i}" for i, t in enumerate(thresholds, 1))])
    shares = lambda f: ", ".join(f"sum({f} * m{i}) AS m{i}" for i in range(len(names)))
    labels = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    value = "CASE n.i " + " ".join(f"WHEN {i} THEN m{i}" for i in range(len(names))) + " END"
    return f"""
        WITH x AS (
          SELECT coalesce(c_mktsegment, '') AS segment, CAST(o_orderdate >= TIMESTAMP '{config["cutoff"]} 00:00:00' AS INT) AS g, coalesce(o_orderpriority, '') || '/' || n_regionkey AS cell,
            CAST(o_totalprice AS DOUBLE) AS y, CAST(o_orderkey AS BIGINT) AS k, unnest(range(0, {config["replications"] + 1})) AS rep
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
        {mixing_rounds_sql("x")},
        r AS (SELECT segment, g, cell, y, rep, CASE WHEN rep = 0 THEN 1 ELSE -ln((h + CAST(0.5 AS DOUBLE)) / CAST(2147483647 AS DOUBLE)) END AS w FROM h3),
        a AS (SELECT segment, rep, g, cell, sum(w) AS w, {sums} FROM r GROUP BY ALL),
        b AS (SELECT segment, rep, cell, sum(w) FILTER (g = 0) AS w0, sum(w) FILTER (g = 1) AS w1 FROM a GROUP BY ALL),
        t AS (SELECT *, sum(w0) OVER (PARTITION BY segment, rep) AS t0, sum(w1) OVER (PARTITION BY segment, rep) AS t1 FROM b WHERE w0 > 0 AND w1 > 0),
        v AS (
          SELECT segment, rep, 0 AS d, {shares("1 / t0")} FROM a JOIN t USING (segment, rep, cell) WHERE g = 0 GROUP BY ALL
          UNION ALL SELECT segment, rep, 1, {shares("w1 / w0 / t1")} FROM a JOIN t USING (segment, rep, cell) WHERE g = 0 GROUP BY ALL
          UNION ALL SELECT segment, rep, 2, {shares("1 / t1")} FROM a JOIN t USING (segment, rep, cell) WHERE g = 1 GROUP BY ALL),
        l AS (SELECT segment, rep, d, n.measure, {value} AS v FROM v, (VALUES {labels}) n(i, measure)),
        p AS (SELECT segment, rep, measure, max(v) FILTER (d = 0) AS l0, max(v) FILTER (d = 1) AS l1, max(v) FILTER (d = 2) AS l2 FROM l GROUP BY ALL),
        e AS (SELECT segment, rep, measure, unnest(['structure', 'composition', 'total']) AS effect, unnest([round(l2 - l1, {order_gap.DIGITS}), round(l1 - l0, {order_gap.DIGITS}), round(l2 - l0, {order_gap.DIGITS})]) AS estimate FROM p),
        s AS (
          SELECT segment, measure, effect, max(estimate) FILTER (rep = 0) AS estimate, stddev_samp(estimate) FILTER (rep > 0) AS se FROM e GROUP BY ALL),
        u AS (
          SELECT e.segment, e.effect, e.rep, max(abs(e.estimate - s.estimate) / s.se) AS t
          FROM e JOIN s ON s.segment = e.segment AND s.measure = e.measure AND s.effect = e.effect WHERE e.rep > 0 AND s.se > 0 GROUP BY ALL),
        q AS (SELECT segment, effect, quantile_cont(t, {1 - alpha!r}) AS c FROM u GROUP BY ALL)
        SELECT s.measure, s.effect, round(estimate, 6) + 0 AS estimate, round(se, 6) AS std_error, round(estimate - {normal_quantile(1 - alpha / 2)!r} * se, 6) AS pointwise_lower,
          round(estimate + {normal_quantile(1 - alpha / 2)!r} * se, 6) AS pointwise_upper, round(estimate - coalesce(c, 0) * se, 6) AS uniform_lower, round(estimate + coalesce(c, 0) * se, 6) AS uniform_upper, nullif(s.segment, '') AS segment
        FROM s LEFT JOIN q ON q.segment = s.segment AND q.effect = s.effect
    """


QUERIES = {"job1_length_gap": job1_length_gap, "job2_order_gap": job2_order_gap}
_LENGTH, _ORDER = length_gap.read_config(), order_gap.read_config()
ORACLE_SQL = {"job1_length_gap": length_gap_sql(_LENGTH["reference"], _LENGTH["probs"]), "job2_order_gap": order_gap_sql(_ORDER)}
