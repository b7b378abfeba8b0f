"""Fill-in-the-middle against a plain Python version."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from countershift.llm import fim, queries

TEXTS = [
    (1, "one\ntwo\nthree\n"), (2, "one\n\n\ntwo"), (3, None), (4, ""), (5, "\n"), (6, "no end"), (7, "has <S> in it\nx"), (8, "cut <\nS>\n<P\n>"), (None, "null id\nb\nc"), (None, None),
    (9, "é中👍🏽\r\n\x85ẛ̣\n" * 50), (10, "line\n" * 100_000), (11, "\n" * 50_000), (12, "x" * 300_000), (13, "a\x00b\n\x00\n"), (14, "same\nrow"), (14, "same\nrow"), (14, "other\nrow\nof it"), (-5, "a\nb\nc\nd"),
    (2**63 - 1, "\\1 '%s' $x\n{}\n"), *[(100 + k, "".join(f"w{j}\n" for j in range(k))) for k in range(60)],
]
SCHEMA = "doc_id long, text string, n long, form string, output string, h string, u string, batch string, made string, a int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "f", "o", "h", "u", "b", "m", 2) for i, t in TEXTS], SCHEMA).repartition(3)


def plain(doc_id, text, unit=fim.LINES, seed=7, rate=100, spm=50, sentinels=fim.SENTINELS):
    """The contract, one text at a time."""
    text, p, s, m = text or "", *sentinels
    units = re.findall(unit, text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in sentinels) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    before, middle, after = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(before), len(middle), f"{s}{after}{p}{before}{m}{middle}" if form == "spm" else f"{p}{before}{s}{after}{m}{middle}"


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("options", [{}, {"seed": 8, "rate": 60, "spm": 20}, {"unit": r"[ ]*[^ ]+|[ ]+"}, {"sentinels": ("⟨pre⟩", "⟨suf⟩", "⟨mid⟩")}])
def test_output_equals_plain_version(docs, options):
    found = sorted((tuple(r) for r in fim.fill_in_middle(docs, **options).collect()), key=key)
    assert found == sorted(((i, *plain(i, t, **options)) for i, t in TEXTS), key=key)
    sentinels = options.get("sentinels", fim.SENTINELS)
    back = sorted((tuple(r) for r in fim.restore(fim.fill_in_middle(docs, **options), sentinels).collect()), key=key)
    assert back == sorted(((i, t or "") for i, t in TEXTS), key=key)


def test_digests_are_those_of_output_and_text(docs, monkeypatch):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = sorted(((i, *(out := plain(i, t))[:4], sha(out[4]), sha(t or "")) for i, t in TEXTS), key=key)
    assert sorted((tuple(r) for r in fim.digests(docs).collect()), key=key) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}
    monkeypatch.setattr(fim, "SLICE_BYTES", 10)  # slices of a row each
    assert sorted((tuple(r) for r in fim.digests(docs.coalesce(1)).collect()), key=key) == expected


def test_empty_table_and_bad_bytes(spark, docs):
    assert fim.digests(docs.limit(0)).collect() == [] == fim.restore(fim.fill_in_middle(docs.where("false"))).collect()
    bad = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(x'61FF0A62' as string)").alias("text"))
    assert fim.restore(fim.fill_in_middle(bad)).first().restored == "a�\nb"


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("<P>", "x<P>y", "z")])
def test_sentinels_that_could_arise_are_refused(docs, sentinels):
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, sentinels=sentinels)


def test_query_equals_plain_version_and_sql(spark, sf_dir):
    found = sorted(tuple(r) for r in queries.QUERIES["op11_fill_in_middle"](spark, sf_dir).collect())
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == sorted((i, *(out := plain(i, t))[:4], sha(out[4]), sha(t or "")) for i, t in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op11_fill_in_middle"]).to_arrow_table().select(["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
    assert found == sorted(tuple(r.values()) for r in sql.to_pylist())
