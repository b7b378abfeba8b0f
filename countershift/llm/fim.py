"""Fill-in-the-middle transformation, by DuckDB inside ``mapInArrow``.

A task registers each slice of its Arrow batches in a DuckDB of its own (one
thread, nothing on disk) and gets Arrow back: ``regexp_extract_all`` cuts a
text into units, ``list_slice`` and ``array_to_string`` make prefix, middle and
suffix of them, and ``sha256`` of seed and id draws the two cuts and the form.
No row passes through Python, nothing is shuffled, and the same row gives the
same result in any layout, so that a lost task is simply run again.

Defined results: null text counts as empty; an empty text, and one that holds a
sentinel, stays as it is (``plain``, no character counts); a null id draws from
the seed alone; rows of one id draw alike, repeated rows give repeated results;
bytes that are no UTF-8 become U+FFFD first; an empty table gives no rows.
Texts are taken whole: a slice holds ``SLICE_BYTES`` of text or one row, and a
unit costs 16 bytes beside its characters. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.text import release_memory

#: A line with its end, or what is left behind the last end. Every character of a text must belong to a match.
LINES = r"[^\n]*\n|[^\n]+"
#: Prefix, suffix and middle sentinel.
SENTINELS = ("<P>", "<S>", "<M>")
SLICE_BYTES = 8 << 20

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuse sentinels that could arise where a piece of a text without sentinels meets one: no end of one may begin another, nor may one hold another."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if any(a.endswith(b[:k]) for k in range(1, len(b))) or (a != b and b in a):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(unit: str, seed: int, rate: int, spm: int, sentinels: tuple[str, str, str]) -> str:
    """DuckDB SQL that makes doc_id, n, form, prefix_chars, middle_chars and output of the relation ``batch`` (doc_id, text)."""
    p, s, m = map(_quoted, sentinels)
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    return f"""
        WITH drawn AS (
          SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
        units AS (
          SELECT doc_id, text, regexp_extract_all(text, {_quoted(unit)}) AS u, {draw(0)} AS h1, {draw(1)} AS h2,
            text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {rate} AS plain,
            {draw(3)} % 100 < {spm} AS suffix_first
          FROM drawn),
        cuts AS (
          SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a,
            CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b
          FROM units),
        parts AS (
          SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
            CASE WHEN NOT plain THEN array_to_string(list_slice(u, 1, a), '') END AS prefix,
            CASE WHEN NOT plain THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle,
            CASE WHEN NOT plain THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix
          FROM cuts)
        SELECT doc_id, n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
          CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
            ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
        FROM parts
    """


def restore_sql(sentinels: tuple[str, str, str]) -> str:
    """DuckDB SQL that adds ``restored`` to the relation ``made``, from ``form`` and ``output`` alone."""
    p, s, m = map(_quoted, sentinels)
    return f"""
        WITH halves AS (
          SELECT *, CASE form WHEN 'psm' THEN string_split(output, {s}) WHEN 'spm' THEN string_split(output, {p}) END AS half FROM made),
        pieces AS (
          SELECT *, substr(half[1], CASE form WHEN 'psm' THEN {len(sentinels[0]) + 1} ELSE {len(sentinels[1]) + 1} END) AS one, string_split(half[2], {m}) AS rest FROM halves)
        SELECT * EXCLUDE (half, one, rest), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || rest[2] || rest[1] ELSE rest[1] || rest[2] || one END AS restored
        FROM pieces
    """


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``SLICE_BYTES`` of the column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, ends[end - 1]


def _by_duckdb(source: DataFrame, sql: str, schema: str, name: str, text: int) -> DataFrame:
    """The rows that the SQL makes of the relation ``name``: each slice of the frame's batches."""

    def run(batches):
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                for part in _slices(batch, text):
                    con.register(name, pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister(name)
        release_memory()

    return source.mapInArrow(run, schema)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` (the training text) of every row.

    ``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix first.
    """
    check_sentinels(sentinels)
    return _by_duckdb(_read(docs, id_col, text_col), transform_sql(unit, seed, rate, spm, sentinels), f"{_SCHEMA}, output string", "batch", 1)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``doc_id``, ``restored`` (the original text) of rows that :func:`fill_in_middle` made."""
    check_sentinels(sentinels)
    sql = f"SELECT doc_id, restored FROM ({restore_sql(sentinels)})"
    return _by_duckdb(made.select(F.col("doc_id").cast("long").alias("doc_id"), "form", "output"), sql, "doc_id long, restored string", "made", 2)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """What :func:`fill_in_middle` returns, with ``output_sha256`` and ``restored_sha256`` in place of the text: transformed, restored and hashed in one pass."""
    check_sentinels(sentinels)
    sql = f"""
        WITH made AS ({transform_sql(unit, seed, rate, spm, sentinels)}), back AS ({restore_sql(sentinels)})
        SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back
    """
    return _by_duckdb(_read(docs, id_col, text_col), sql, f"{_SCHEMA}, output_sha256 string, restored_sha256 string", "batch", 1)
