"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countershift.llm import bpe, chat, exactdup, fim, langid, licenses, lm, minhash, packing, simhash, topk, urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: verdict, host and path of the URL rules.
RULES = [
    urls.Rule.parse("allow", "org/"),
    urls.Rule.parse("block", "example.org/es/"),
    urls.Rule.parse("block", "example.org/en/1"),
    urls.Rule.parse("allow", "com/fr/"),
    urls.Rule.parse("block", "com/de/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(more), TOKENIZER, budget=1024, history=128))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # a non-finite component stays what it is, so that its vector takes no part
    scaled = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(64 * x.cast("double")).cast("double")))
    vectors = table.select("vec_id", scaled.alias("embedding"))
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), TOKENIZER)


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_read(spark, sf_dir, "documents"), unit=fim.LINES, seed=7, rate=100, spm=50)


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(_read(spark, sf_dir, "documents"), words=5, percent=85)


# ---- parts of the results above that SQL can express ------------------------------------------


def chat_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting(spark, sf_dir).drop("formatted_chars")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(spark, sf_dir)
    return found.select("doc_id", "held_out", (F.col("lang_pred") == langid.UNKNOWN).alias("without_letter"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, sf_dir).withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict")))


QUERIES = {
    "op1_license_scan": license_scan,
    "op2_best_fit_packing": best_fit_packing,
    "op3_chat_formatting": chat_formatting,
    "op4_exact_top_k": exact_top_k,
    "op5_simhash_dedup": simhash_dedup,
    "op6_exact_dedup": exact_dedup,
    "op7_language_id": language_id,
    "op8_bpe": bpe_round_trip,
    "op9_lm_scoring": lm_scoring,
    "op10_url_filter": url_filter,
    "op11_fill_in_middle": fill_in_middle,
    "op12_minhash_dedup": minhash_dedup,
    "turns_read_back": chat_read_back,
    "language_folds": language_folds,
    "lm_base_scores": lm_base_scores,
    "url_rules": url_rules,
}


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: eight shifts a byte, with the reversed polynomial where a one falls out."""
    byte = "list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    values = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), lambda c, b: {byte}), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)

ORACLE_SQL = {
    "op4_exact_top_k": """
        WITH usable AS (
          SELECT DISTINCT vec_id, embedding FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
        v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM usable),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (
          SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
          FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    # by the places of line ends, without cutting into a list: what comes back is the text itself
    "op11_fill_in_middle": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        c AS (
          SELECT *, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) - CAST(text = '' OR suffix(text, chr(10)) AS INTEGER) AS n FROM d),
        k AS (
          SELECT *, list_transform([1, 9], lambda x: CAST('0x' || h[x:x + 7] AS UBIGINT) % (n + 1)) AS cuts, CAST('0x' || h[17:24] AS UBIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS h4 FROM c),
        p AS (
          SELECT *, regexp_matches(text, '<[PSM]>') OR text = '' OR h3 >= 100 AS plain,
            CAST(list_sum(list_prepend(0, list_transform(l[1:list_min(cuts)], lambda x: length(x) + 1))) AS BIGINT) AS a,
            CAST(list_sum(list_prepend(0, list_transform(l[1:list_max(cuts)], lambda x: length(x) + 1))) AS BIGINT) AS b FROM k),
        o AS (
          SELECT *, CASE WHEN plain THEN text
            WHEN h4 < 50 THEN '<S>' || substr(text, b + 1) || '<P>' || left(text, a) || '<M>' || substr(text, a + 1, b - a)
            ELSE '<P>' || left(text, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a) END AS output FROM p)
        SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form,
          CASE WHEN NOT plain THEN least(a, length(text)) END AS prefix_chars, CASE WHEN NOT plain THEN least(b, length(text)) - least(a, length(text)) END AS middle_chars,
          sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
    """,
    "turns_read_back": """
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g AS (
          SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
          FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM g
    """,
    "language_folds": f"""
        SELECT doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS held_out, NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS without_letter FROM documents
    """,
    "lm_base_scores": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 10 = 0 AS held_out, {_LOWER} AS text FROM documents),
        w AS (
          SELECT r, held_out, unnest(list_append(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), chr(0) || 'end')) AS token FROM d),
        c AS (SELECT token, count(*) AS c FROM w WHERE NOT held_out GROUP BY token),
        n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
        s AS (
          SELECT w.r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + CAST(0.1 AS DOUBLE)) / (n.n + CAST(0.1 AS DOUBLE) * (n.v + 1)))) AS base_score
          FROM w LEFT JOIN c ON c.token = w.token, n GROUP BY w.r)
        SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, round(base_score, 6) AS base_score FROM d JOIN s ON s.r = d.r, n
    """,
    "url_rules": f"""
        WITH p AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        f AS (
          SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, r.host || r.path) AS place
          FROM p LEFT JOIN (VALUES {_RULES_SQL}) r(verdict, host, path) ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, verdict FROM f WHERE place = 1
    """,
}
