"""Tables, summaries, plots and files of a decomposition."""

from __future__ import annotations

import csv
import json
import os
import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from countershift import schemas
from countershift.checks import choice
from countershift.errors import DecompositionError
from countershift.plans.decompose import Decomposition
from countershift.sources.sinks import write_together

# The output files.
REQUIRED = ("decomposition.csv", "distribution_diagnostics.csv", "point_resources.csv", "marginalization_diagnostics.csv", "run_metadata.csv", "fit.pkl")
CONDITIONAL = ("bootstrap_resources.csv", "bootstrap_failures.csv", "functional_effect_tests.csv", "quantile_crossing_diagnostics.csv")


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = schemas.names(schema)
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return spark.createDataFrame([tuple(plain(r.get(n)) for n in names) for r in rows], schema)


def decomposition_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    return _frame(spark, result.rows(), schemas.DECOMPOSITION)


def marginalization_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    return _frame(spark, result.point.marginalization, schemas.MARGINALIZATION)


def observed_rows(result: Decomposition) -> list[dict]:
    return [{"quantile": float(q)} | {k: _none(v[i]) for k, v in result.point.levels.items()} for i, q in enumerate(result.quantiles)]


def observed_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    return _frame(spark, observed_rows(result), schemas.OBSERVED)


def crossing_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    return _frame(spark, result.crossing, schemas.CROSSING)


def tests_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    return _frame(spark, [r | {"null_value": _none(r["null_value"])} for r in result.tests], schemas.FUNCTIONAL)


def draws_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    rows = [(r + 1, e, float(q), _none(v)) for e, d in (result.draws or {}).items() for r, row in enumerate(d) for q, v in zip(result.quantiles, row)]
    return spark.createDataFrame(rows, "replication int, effect string, quantile double, estimate double")


def coefficient_table(spark: SparkSession, result: Decomposition) -> DataFrame:
    rows = [x for g, fit in enumerate(result.point.fits) for x in fit.tidy(result.metadata["design_columns"], g)]
    return spark.createDataFrame(rows, "group int, grid_value double, term string, coef double")


def _none(v):
    return None if v is None or not np.isfinite(v) else float(v)


def summary(result: Decomposition, effects: Iterable[str] | None = None, quantiles: Iterable[float] | None = None) -> pd.DataFrame:
    """Rows of the asked effects at the stored quantiles nearest to the asked ones."""
    effects = tuple(schemas.EFFECTS if effects is None else effects)
    for e in effects:
        choice("effects", e, schemas.EFFECTS)
    table = pd.DataFrame(result.rows(), columns=schemas.names(schemas.DECOMPOSITION))
    if quantiles is not None:
        asked = [float(q) for q in quantiles]
        if not asked or not all(0 < q < 1 for q in asked):
            raise DecompositionError("quantiles must lie strictly between 0 and 1")
        near = {float(result.quantiles[np.argmin(np.abs(result.quantiles - q))]) for q in asked}
        table = table[table["quantile"].isin(near)]
    return table[table["effect"].isin(effects)].reset_index(drop=True)


def describe(result: Decomposition) -> str:
    m = result.metadata
    head = f"Counterfactual decomposition: model {result.model}" + (f", solver {result.solver}" if result.solver else "")
    lines = [head, f"{m['observations']} observations ({m['observations_reference']} reference, {m['observations_comparison']} comparison), {m['omitted_rows']} omitted; {result.reps} replications"]
    table = summary(result).pivot(index="quantile", columns="effect", values="estimate")[list(schemas.EFFECTS)]
    return "\n".join([*lines, table.to_string(float_format=lambda v: f"{v:.6g}")])


Decomposition.__repr__ = describe
Decomposition.to_df = lambda self, spark: decomposition_table(spark, self)
Decomposition.summary = summary


def islands(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true places as [start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, int), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def plot(result: Decomposition, path: str | None = None, band: str = "pointwise", effects: Iterable[str] | None = None, width: int = 720, height: int = 260) -> tuple[pd.DataFrame, str]:
    """The plotted rows and an SVG of the effects with their bands (none, pointwise or uniform)."""
    choice("band", band, ("pointwise", "uniform", "none"))
    table = summary(result, effects)
    parts, top = [], 0
    for effect in table["effect"].unique():
        own = table[table["effect"] == effect]
        q, y = own["quantile"].to_numpy(float), own["estimate"].to_numpy(float)
        low = high = np.full(len(q), np.nan)
        if band != "none":
            low, high = own[f"{band}_lower"].to_numpy(float), own[f"{band}_upper"].to_numpy(float)
        every = np.concatenate([y, low, high, [0.0]])
        every = every[np.isfinite(every)]
        a, b = every.min(), every.max()
        span = (b - a) or 1.0
        sx = lambda v: 60 + (width - 80) * v
        sy = lambda v, a=a, span=span, top=top: top + height - 35 - (height - 65) * (v - a) / span
        parts.append(f'<text x="60" y="{top + 20}" font-size="14">{effect}</text><line x1="60" x2="{width - 20}" y1="{sy(0):.1f}" y2="{sy(0):.1f}" stroke="#999"/>')
        for s, e in islands(np.isfinite(low) & np.isfinite(high)):
            points = [(sx(q[k]), sy(high[k])) for k in range(s, e)] + [(sx(q[k]), sy(low[k])) for k in reversed(range(s, e))]
            parts.append('<polygon fill="#cde" points="' + " ".join(f"{x:.1f},{v:.1f}" for x, v in points) + '"/>')
        for s, e in islands(np.isfinite(y)):
            parts.append('<polyline fill="none" stroke="#024" stroke-width="1.5" points="' + " ".join(f"{sx(q[k]):.1f},{sy(y[k]):.1f}" for k in range(s, e)) + '"/>')
        for v in (a, b):
            parts.append(f'<text x="4" y="{sy(v):.1f}" font-size="11">{v:.3g}</text>')
        top += height
    svg = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{top}" font-family="sans-serif">' + "".join(parts) + "</svg>"
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(svg)
    return table, svg


def _csv(path: str, rows: list[dict], names: list[str] | None = None) -> None:
    names = names or list(rows[0])
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(names)
        for r in rows:
            out.writerow(["NA" if (v := r.get(n)) is None or (isinstance(v, float) and np.isnan(v)) else str(v).upper() if isinstance(v, (bool, np.bool_)) else v for n in names])


def write_outputs(result: Decomposition, output_dir: str) -> list[str]:
    """All files of a result, committed together."""

    def write(stage: str) -> None:
        at = lambda n: os.path.join(stage, n)
        _csv(at("decomposition.csv"), result.rows(), schemas.names(schemas.DECOMPOSITION))
        _csv(at("distribution_diagnostics.csv"), observed_rows(result), schemas.names(schemas.OBSERVED))
        _csv(at("point_resources.csv"), result.point.resources)
        _csv(at("marginalization_diagnostics.csv"), result.point.marginalization, schemas.names(schemas.MARGINALIZATION))
        _csv(at("run_metadata.csv"), [{"field": k, "value": json.dumps(v) if isinstance(v, (list, tuple, dict)) else v} for k, v in result.metadata.items()])
        with open(at("fit.pkl"), "wb") as f:
            pickle.dump(result, f)
        if result.draws is not None:
            _csv(at("bootstrap_resources.csv"), result.bootstrap_resources)
        if result.bootstrap_failures:
            _csv(at("bootstrap_failures.csv"), result.bootstrap_failures)
        if result.tests:
            _csv(at("functional_effect_tests.csv"), result.tests, schemas.names(schemas.FUNCTIONAL))
        if result.crossing:
            _csv(at("quantile_crossing_diagnostics.csv"), result.crossing, schemas.names(schemas.CROSSING))

    return write_together(output_dir, REQUIRED + CONDITIONAL, write, REQUIRED)
