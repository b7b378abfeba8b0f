"""The decomposition as a table function for SQL, one decomposition per partition.

``SELECT * FROM cf_decompose(TABLE(t) PARTITION BY (year), 'y ~ x + f', 'g', 'w', 'qr', 'year')``

decomposes all years side by side, one task after the other or at the same time
as Spark deals them out; ``WITH SINGLE PARTITION`` decomposes the whole table in
one. Columns are those of the arguments: the key, if one is named, then effect,
quantile and estimate. Rows of a key are kept as packed numbers (8 bytes a value
and column) in the task of the key. A column of frequencies may be named last, so
that the table can be one of distinct rows, which Spark counts before they are
sent (``SELECT k, y, x, g, count(*) AS n ... GROUP BY k, y, x, g``); a group that
doesn't fit a task goes through :func:`countershift.counterfactual_decompose`,
whose rows stay on executors.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from countershift.errors import DecompositionError


#: Draws of a group that are sorted at once; tasks of several keys share an executor, and more draws than that are counted in chunks.
MATRIX_MB = 32.0


def _terms(formula: str) -> tuple[str, list[str]]:
    """Response and covariates of ``y ~ a + factor(b)``."""
    left, tilde, right = formula.partition("~")
    names = [t.strip() for t in right.split("+") if t.strip() not in ("", "1")]
    if not tilde or not left.strip() or any(not n.removeprefix("factor(").removesuffix(")").isidentifier() for n in names):
        raise DecompositionError("a formula is of the form y ~ a + factor(b), with names of columns")
    return left.strip(), names


@udtf
class DecomposeTable:
    """Numbers, and strings or ``factor(...)`` as categories; incomplete rows are left out, and a key without both groups has no rows."""

    @staticmethod
    def analyze(table: AnalyzeArgument, formula: AnalyzeArgument, group: AnalyzeArgument, weight: AnalyzeArgument, model: AnalyzeArgument, key: AnalyzeArgument | None = None, frequency: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise DecompositionError("the first argument is a table")
        known = {f.name: f.dataType for f in table.dataType.fields}
        response, names = _terms(formula.value)
        asked = [response, *(n.removeprefix("factor(").removesuffix(")") for n in names), group.value, *([weight.value] if weight.value else []), *[a.value for a in (key, frequency) if a is not None and a.value]]
        missing = [n for n in asked if n not in known]
        if missing:
            raise DecompositionError(f"no columns {missing}")
        schema = T.StructType()
        if key is not None and key.value:
            schema = schema.add(key.value, known[key.value])
        return AnalyzeResult(schema=schema.add("effect", T.StringType()).add("quantile", T.DoubleType()).add("estimate", T.DoubleType()))

    def __init__(self):
        self.columns: dict[str, array] = {}
        self.levels: dict[str, dict] = {}
        self.arguments, self.key, self.keyed = None, None, False

    def eval(self, row, formula: str, group: str, weight: str, model: str, key: str | None = None, frequency: str | None = None):
        if self.arguments is None:
            self.arguments = (formula, group, weight, model)
            self.response, self.names = _terms(formula)
        if key:
            self.key, self.keyed = row[key], True
        # no covariate has a name that begins like these
        values = {"#y": row[self.response], "#g": row[group], "#w": row[weight] if weight else 1.0, "#n": row[frequency] if frequency else 1.0}
        for n in self.names:
            name = n.removeprefix("factor(").removesuffix(")")
            v = row[name]
            if v is not None and (name != n or isinstance(v, (str, bool))):
                held = self.levels.setdefault(n, {})
                v = held.setdefault(str(v), len(held))
            values[n] = v
        if any(v is None or not math.isfinite(v) for v in values.values()) or values["#n"] == 0:
            return
        if values["#n"] < 0 or values["#n"] != int(values["#n"]):
            raise DecompositionError("frequencies are whole numbers")
        for n, v in values.items():
            self.columns.setdefault(n, array("d")).append(float(v))

    def terminate(self):
        if not self.columns:
            return
        from countershift.control import Control
        from countershift.operators.blocks import LocalBlocks
        from countershift.plans.decompose import estimate_point, validate
        from countershift.sources.prepare import Prepared, content_hash, reduce_design

        model = self.arguments[3]
        table = {n: np.frombuffer(v, float) for n, v in self.columns.items()}
        order = np.argsort(content_hash(list(table.values())), kind="stable")
        sides = [order[table["#g"][order] == g] for g in (0, 1)]
        if not all(len(at) for at in sides):
            return
        mean = (table["#w"] * table["#n"]).sum() / table["#n"].sum()

        def blocks(at: np.ndarray) -> LocalBlocks:
            parts = [np.ones((len(at), 1))]
            for n in self.names:
                if n in self.levels:
                    codes = [self.levels[n][level] for level in sorted(self.levels[n])]
                    parts.append((table[n][at, None] == np.array(codes[1:])[None, :]).astype(float))
                else:
                    parts.append(table[n][at, None])
            return LocalBlocks(np.column_stack(parts), table["#y"][at], table["#w"][at] * table["#n"][at] / mean, table["#n"][at])

        groups = tuple(blocks(at) for at in sides)
        # the rows are in the blocks now
        del table, order, sides, blocks
        self.columns = {}
        prepared = reduce_design(Prepared(groups, [str(k) for k in range(groups[0].p)], [], 0, "kernel", 1.0))
        control = Control(marginal_matrix_max_mb=MATRIX_MB)
        point = estimate_point(prepared.groups, model, validate(model, None, control), control, with_observed=False)
        for effect, values in point.effects.items():
            for q, v in zip(control.reported_quantiles, values):
                yield (*([self.key] if self.keyed else []), effect, float(q), None if np.isnan(v) else float(v))


def register(spark: SparkSession, name: str = "cf_decompose") -> None:
    spark.udtf.register(name, DecomposeTable)
