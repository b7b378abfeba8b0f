"""Language identification by hyperdimensional letter n-gram profiles.

Every letter has a random vector of +1 and -1, made from a hash of its code
point. An n-gram binds its letters' vectors (multiplied, each rotated by its
distance from the last). A text bundles (adds up) the vectors of all its
n-grams; a language's prototype adds up its training texts' unit vectors. The
prediction is the prototype of largest cosine, the score that cosine (at least
0). Letters are lower-cased, runs of anything else count as one border letter.

Training sums integers, so neither order nor retries change a prototype. Only
prototypes (languages x dimensions) reach the driver; more than
``MAX_LANGUAGES`` labels are refused.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing was learnt; equal cosines go to the language that
sorts first; equal rows have equal results; texts over 4 MB are counted in
blocks cut at white space; a null id counts as the empty string for the folds;
an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countershift.llm.shared import drop, materialize
from countershift.llm.text import blocks, release_memory

DIMENSIONS = 512
GRAM = 3
MAX_LANGUAGES = 4096
UNKNOWN = "und"
_BORDER = 32
_SCALE = 1 << 24
_GROUP = 128
_LONG = 4 << 20

_letters = np.array([chr(c).isalpha() for c in range(0x3000)])


def _symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others as one border, with borders at both ends; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[np.minimum(codes, len(_letters) - 1)]
    if len(codes) and codes.max() >= len(_letters):
        far = np.flatnonzero(codes >= len(_letters))
        kinds, back = np.unique(codes[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[back]
    if not letter.any():
        return np.empty(0, np.int64)
    out = np.full(len(codes) + 2, _BORDER, np.int64)
    out[1:-1][letter] = codes[letter]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _BORDER) | (out[:-1] != _BORDER)
    return out[keep]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams (packed code points) and how often each stands in it."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = [text] if len(text) < _LONG // 4 else [b.decode() for b in blocks(text.encode("utf-8", "surrogatepass"), _LONG)]
    found = []
    for part in parts:
        s = _symbols(part)
        if len(s) >= GRAM:
            found.append(np.unique((s[:-2] << 42) | (s[1:-1] << 21) | s[2:], return_counts=True))
    if len(found) < 2:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    grams, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, from a 64-bit mixing hash."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xD1B54A32D192ED03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.unpackbits(z.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of packed n-grams."""
    mask = (1 << 21) - 1
    letters = np.stack([grams >> 42, (grams >> 21) & mask, grams & mask])
    kinds, back = np.unique(letters, return_inverse=True)
    vectors, back = letter_vectors(kinds), back.reshape(letters.shape)
    return np.roll(vectors, 2, axis=1)[back[0]] * np.roll(vectors, 1, axis=1)[back[1]] * vectors[back[2]]


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of texts; a row of zeros where there is no letter."""
    return _unit_vectors([gram_counts(t) for t in texts])


def _unit_vectors(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(counts), DIMENSIONS), np.float32)
    if not any(len(g) for g, _ in counts):
        return out
    kinds, back = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    vectors = gram_vectors(kinds).astype(np.float32)
    at = 0
    for k, (grams, n) in enumerate(counts):
        if len(grams):
            out[k] = n.astype(np.float32) @ vectors[back[at : at + len(grams)]]
            at += len(grams)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def _groups(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, _GROUP):
        yield batch.slice(at, _GROUP)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows whose label isn't null."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _groups(batch):
                vectors = np.rint(text_vectors(part.column(1).to_pylist()) * _SCALE).astype(np.int64)
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        release_memory()
        if sums:
            names = list(sums)
            yield pa.record_batch(
                [pa.array(np.repeat(np.array(names, object), DIMENSIONS), pa.string()), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(names))), pa.array(np.concatenate([sums[n] for n in names]))],
                names=["lang", "dim", "value"],
            )

    source = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = source.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    table = materialize(sums, "langid-sums")
    if table.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in table.collect():
        out.setdefault(lang, np.zeros(DIMENSIONS))[dim] = value
    drop(table)
    return {k: v / size for k, v in sorted(out.items()) if (size := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Columns ``keep``, then ``lang_pred``, ``score`` and ``grams`` (the text's n-grams). No shuffle."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(-1, DIMENSIONS).T

    def run(batches):
        labels = np.array([*names, UNKNOWN], object)
        for batch in batches:
            for part in _groups(batch):
                counts = [gram_counts(t) for t in part.column(0).to_pylist()]
                vectors = _unit_vectors(counts)
                known = vectors.any(axis=1) & bool(names)
                best, score = np.full(part.num_rows, len(names)), np.zeros(part.num_rows)
                if names:
                    cosines = vectors @ matrix
                    best[known] = cosines.argmax(axis=1)[known]
                    score[known] = np.clip(cosines.max(axis=1)[known], 0, 1)
                columns = [*part.columns[1:], pa.array(labels[best], pa.string()), pa.array(score, pa.float64()), pa.array([int(n.sum()) for _, n in counts], pa.int64())]
                yield pa.record_batch(columns, names=[*part.schema.names[1:], "lang_pred", "score", "grams"])
        release_memory()

    source = docs.select(F.col(text_col).cast("string").alias("text_"), *keep)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(run, kept + "lang_pred string, score double, grams long")


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows outside fold 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(id_col, folds) == 0).alias("held_out"))
    prototypes = learn(rows.where(~F.col("held_out")))
    return predict(rows, prototypes, keep=["doc_id", "held_out"]).drop("grams")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, least: float = 0.0, grams: int = 0) -> DataFrame:
    """Rows of ``docs`` in which a language was found, all columns; ``und`` goes.

    So does a text whose score isn't over ``least``, if it has ``grams`` n-grams
    or more: a text of few n-grams is near no prototype even in its own language.
    """
    prototypes = learn(docs.where(fold(id_col, folds) != 0), text_col, lang_col)
    names = [f"c{k}_" for k in range(len(docs.columns))]
    renamed = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    found = predict(renamed, prototypes, names[docs.columns.index(text_col)], keep=names)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") > least) | (F.col("grams") < grams)))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
