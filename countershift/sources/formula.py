"""A small formula language compiled to DataFrame columns.

``y ~ x1 + f + x1:f + a*b + I(x1^2) + log(x2)``: numeric terms give one column,
booleans and strings one 0/1 column per level but the first in sort order.
``I(x > 3 & z <= 1)`` is a boolean, ``cut(x, c(0, 10, Inf))`` a factor of
intervals (open below, closed above; a row in none of them is incomplete),
``poly(x, 3)`` gives orthogonal polynomials over the frame's rows and
``poly(x, 3, raw = TRUE)`` powers; ``bs(x, df = 5)`` and ``ns(x, knots = c(1, 2))``
give splines with exact quantiles as knots, ``cut(x, 4)`` ranges of equal width,
``scale(x)`` standardises; ``ifelse``, ``pmin`` and ``pmax`` compute.
Inside an interaction a factor keeps all levels where its margin isn't in the
model. The intercept is always there; offsets are refused.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countershift.errors import DecompositionError

INTERCEPT = "(Intercept)"
MAX_LEVELS = 1000
MAX_KNOTS = 100
_FUNCTIONS = {
    "log": F.ln, "ln": F.ln, "log2": F.log2, "log10": F.log10, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "log1p": F.log1p, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "tanh": F.tanh, "floor": F.floor, "ceiling": F.ceil, "sign": F.signum,
}
_COMPARISONS = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


@dataclass(frozen=True)
class Design:
    """Response and design columns by name, all doubles; ``used`` are the input columns they read."""

    response: Column
    columns: tuple[tuple[str, Column], ...]
    used: tuple[str, ...]


def _split(text: str, mark: str) -> list[str]:
    """Split at a mark that stands outside parentheses and back quotes."""
    out, depth, quoted, now = [], 0, False, ""
    for c in text:
        if c == "`":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        if c == mark and depth == 0 and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    if depth or quoted:
        raise DecompositionError(f"unbalanced formula: {text}")
    return [x.strip() for x in (*out, now)]


def _tree(text: str) -> tuple[ast.expr, dict[str, str]]:
    """The parsed expression, and the columns that stand for its quoted names."""
    names: dict[str, str] = {}

    def quoted(m):
        names[key := f"q{len(names)}_"] = m[1]
        return key

    source = re.sub(r"`([^`]*)`", quoted, text).replace("^", "**")
    # logical operators bind weaker than comparisons, as the words do here
    source = re.sub(r"&&?", " and ", source)
    source = re.sub(r"\|\|?", " or ", source)
    source = re.sub(r"!(?!=)", " not ", source)
    try:
        return ast.parse(source.strip(), mode="eval").body, names
    except SyntaxError:
        raise DecompositionError(f"can't read {text!r}") from None


def _is_logical(node: ast.expr) -> bool:
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "I" and len(node.args) == 1:
        return _is_logical(node.args[0])
    return isinstance(node, (ast.Compare, ast.BoolOp)) or (isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not))


def _arithmetic(text: str, schema: T.StructType, used: set[str]) -> Column:
    """An expression over numeric columns; a condition is 1 or 0."""
    tree, names = _tree(text)
    out = _built(tree, names, text, schema, used)
    return out.cast("double") if _is_logical(tree) else out


def _built(tree: ast.expr, names: dict[str, str], text: str, schema: T.StructType, used: set[str]) -> Column:
    operators = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b}

    def value(node) -> Column:
        return condition(node).cast("double") if _is_logical(node) else build(node)

    def condition(node) -> Column:
        if isinstance(node, ast.Call):
            return condition(node.args[0])
        if isinstance(node, ast.UnaryOp):
            return ~condition(node.operand)
        if isinstance(node, ast.BoolOp):
            parts = [condition(v) if _is_logical(v) else build(v) != 0 for v in node.values]
            return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)
        sides = [value(v) for v in (node.left, *node.comparators)]
        return reduce(lambda a, b: a & b, [_COMPARISONS[type(op)](x, y) for op, x, y in zip(node.ops, sides, sides[1:])])

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            name = names.get(node.id, node.id)
            return _numeric(name, schema, used)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            if isinstance(node.right, ast.Constant) and node.right.value in (2, 3):
                base = build(node.left)
                return base * base if node.right.value == 2 else base * base * base
            return F.pow(build(node.left), build(node.right))
        if isinstance(node, ast.BinOp) and type(node.op) in operators:
            return operators[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            name, arguments = node.func.id, node.args
            if name == "I" and len(arguments) == 1:
                return value(arguments[0])
            if name in _FUNCTIONS and len(arguments) == 1:
                return _FUNCTIONS[name](value(arguments[0])).cast("double")
            if name == "ifelse" and len(arguments) == 3 and _is_logical(arguments[0]):
                test = condition(arguments[0])
                return F.when(test, value(arguments[1])).when(~test, value(arguments[2]))
            if name in ("pmin", "pmax") and len(arguments) > 1:
                parts = [value(v) for v in arguments]
                known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
                return F.when(known, (F.least if name == "pmin" else F.greatest)(*parts))
        raise DecompositionError(f"can't compute {text!r}")

    return condition(tree) if _is_logical(tree) else build(tree)


def _number(node: ast.expr) -> float:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_number(node.operand)
    if isinstance(node, ast.Name) and node.id == "Inf":
        return float("inf")
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return float(node.value)
    raise DecompositionError("a number is needed")


def _wide(text: str, data: DataFrame, schema: T.StructType, used: set[str]) -> tuple[list[tuple[str, Column]], bool] | None:
    """A variable of several columns: (suffix, column) of each, and whether they are a factor's levels. None: one column."""
    if text.strip("`") in schema.names:
        return None
    tree, names = _tree(text)
    if _is_logical(tree):
        test = _built(tree, names, text, schema, used)
        return [("FALSE", (~test).cast("double")), ("TRUE", test.cast("double"))], True
    if not (isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name) and tree.func.id in ("cut", "poly", "bs", "ns", "scale") and len(tree.args) in ((1, 2) if tree.func.id != "poly" else (2,))):
        return None
    x = _built(tree.args[0], names, text, schema, used)
    if tree.func.id in ("bs", "ns"):
        return _splines(tree, x, text, data), False
    if tree.func.id == "scale":
        if len(tree.args) > 1 or tree.keywords:
            raise DecompositionError("scale takes a variable alone")
        mean, sd = _known(data, x).agg(F.avg("v"), F.stddev_samp("v")).first()
        if not sd:
            raise DecompositionError(f"{text!r} needs two distinct values")
        return [("", (x - F.lit(mean)) / F.lit(sd))], False
    if tree.func.id == "cut" and len(tree.args) == 2 and not tree.keywords and not isinstance(tree.args[1], ast.Call):
        return _equal_cuts(x, _number(tree.args[1]), text, data), True
    options = {k.arg: isinstance(k.value, ast.Name) and k.value.id in ("TRUE", "T") for k in tree.keywords}
    if tree.func.id == "cut":
        if options or len(tree.args) < 2 or not isinstance(tree.args[1], ast.Call) or len(tree.args[1].args) < 3:
            raise DecompositionError("cut needs three breaks at least, as c(...), and takes nothing else")
        breaks = sorted({_number(v) for v in tree.args[1].args})
        shown = [f"{b:.3g}".replace("inf", "Inf") for b in breaks]
        held = (x > breaks[0]) & (x <= breaks[-1])
        return [(f"({shown[k]},{shown[k + 1]}]", F.when(held, ((x > breaks[k]) & (x <= breaks[k + 1])).cast("double"))) for k in range(len(breaks) - 1)], True
    degree = int(_number(tree.args[1]))
    if degree < 1 or degree > 20 or set(options) - {"raw"}:
        raise DecompositionError("poly needs a degree from 1 to 20, and raw at most")
    if options.get("raw"):
        return [(str(k), F.pow(x, F.lit(float(k)))) for k in range(1, degree + 1)], False
    # the three-term recurrence, whose coefficients are sums over the frame's rows
    now, before, size, last, out = F.lit(1.0), F.lit(0.0), None, None, []
    for k in range(degree + 1):
        size, moment = data.select(now.alias("p"), x.alias("x")).where("x is not null").agg(F.sum(F.col("p") * F.col("p")), F.sum(F.col("x") * F.col("p") * F.col("p"))).first()
        if not size or size <= 0:
            raise DecompositionError(f"{text!r} needs more distinct values than its degree")
        if k:
            out.append((str(k), now / F.lit(size**0.5)))
        now, before = (x - F.lit(moment / size)) * now - (F.lit(size / last) * before if k else F.lit(0.0)), now
        last = size
    return out, False


def _known(data: DataFrame, x: Column) -> DataFrame:
    """The variable's finite values as ``v``."""
    return data.select(x.cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('Infinity')")


def _equal_cuts(x: Column, number: float, text: str, data: DataFrame) -> list[tuple[str, Column]]:
    """Indicators of ranges of equal width over the variable's values, whose ends are moved out by a thousandth."""
    n = int(number)
    if n < 2 or n != number:
        raise DecompositionError("cut needs breaks, or a number of ranges from 2 on")
    low, high = _known(data, x).agg(F.min("v"), F.max("v")).first()
    if low is None or low == high:
        raise DecompositionError(f"{text!r} needs two distinct values")
    inner = [low + (high - low) * k / n for k in range(1, n)]
    breaks = [low - (high - low) / 1000, *inner, high + (high - low) / 1000]
    held = (x > breaks[0]) & (x <= breaks[-1])
    return [(f"({breaks[k]:.3g},{breaks[k + 1]:.3g}]", F.when(held, ((x > breaks[k]) & (x <= breaks[k + 1])).cast("double"))) for k in range(n)]


def _splines(tree: ast.Call, x: Column, text: str, data: DataFrame) -> list[tuple[str, Column]]:
    """B-spline columns (``bs``) or cubic ones that are linear at the ends (``ns``): knots from exact quantiles, the recursion as columns.

    ``df`` counts columns, ``knots`` are the inner ones, ``degree`` is that of ``bs``. The first B-spline is left to the intercept.
    """
    natural = tree.func.id == "ns"
    given = {k.arg: k.value for k in tree.keywords} | ({"df": tree.args[1]} if len(tree.args) > 1 else {})
    if set(given) - ({"df", "knots"} if natural else {"df", "knots", "degree"}) or {"df", "knots"} <= set(given):
        raise DecompositionError(f"{text!r}: give df or knots" + ("" if natural else ", and degree"))
    degree = int(_number(given["degree"])) if "degree" in given else 3
    if not 1 <= degree <= 5:
        raise DecompositionError("splines have degrees from 1 to 5")
    values = _known(data, x)
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None or low == high:
        raise DecompositionError(f"{text!r} needs two distinct values")
    if "knots" in given:
        node = given["knots"]
        inner = sorted({_number(k) for k in (node.args if isinstance(node, ast.Call) else [node])})
    else:
        count = int(_number(given["df"])) - (1 if natural else degree) if "df" in given else 0
        if not 0 <= count <= MAX_KNOTS:
            raise DecompositionError(f"{text!r}: df is out of range")
        from countershift.operators.frame import exact_quantiles

        probs = [(k + 1) / (count + 1) for k in range(count)]
        found = exact_quantiles(values.select(F.lit(0).alias("g"), "v", F.lit(1.0).alias("w")), "v", "w", probs, "g").collect() if count else []
        inner = sorted({r["q"] for r in found})
    if any(not low < k < high for k in inner) or len(inner) > MAX_KNOTS:
        raise DecompositionError(f"{text!r}: knots must lie inside the variable's range")
    knots = [low] * (degree + 1) + inner + [high] * (degree + 1)
    base = bspline_columns(x, knots, degree)
    if not natural:
        return [(str(k), c) for k, c in enumerate(base[1:], 1)]
    # the combinations whose second derivative is zero at both ends
    ends = np.array([_second_derivatives(knots, end) for end in (low, high)])[:, 1:]
    full, _ = np.linalg.qr(ends.T, mode="complete")
    columns = []
    for k in range(2, full.shape[1]):
        columns.append((str(k - 1), reduce(lambda a, b: a + b, [c * F.lit(float(f)) for c, f in zip(base[1:], full[:, k])])))
    return columns


def bspline_columns(x: Column, knots: list[float], degree: int) -> list[Column]:
    """The B-splines of a knot sequence by their recursion; the last range holds its right end."""
    last = max(k for k in range(len(knots) - 1) if knots[k] < knots[k + 1])
    level = [F.lit(0.0) if a == b else F.when((x >= a) & ((x <= b) if k == last else (x < b)), 1.0).otherwise(0.0) for k, (a, b) in enumerate(zip(knots, knots[1:]))]
    for d in range(1, degree + 1):
        following = []
        for k in range(len(level) - 1):
            left, right = knots[k + d] - knots[k], knots[k + d + 1] - knots[k + 1]
            parts = ([(x - F.lit(knots[k])) / F.lit(left) * level[k]] if left > 0 else []) + ([(F.lit(knots[k + d + 1]) - x) / F.lit(right) * level[k + 1]] if right > 0 else [])
            following.append(reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0))
        level = following
    return [F.when(x.isNotNull(), c) for c in level]


def _second_derivatives(knots: list[float], at: float) -> list[float]:
    """Of the cubic B-splines, from differences of linear ones."""
    k = np.asarray(knots)
    last = max(i for i in range(len(k) - 1) if k[i] < k[i + 1])
    level = [float(a < b and a <= at and (at < b or i == last)) for i, (a, b) in enumerate(zip(k, k[1:]))]
    ratio = lambda a, b: a / b if b > 0 else 0.0
    linear = [ratio(at - k[i], k[i + 1] - k[i]) * level[i] + ratio(k[i + 2] - at, k[i + 2] - k[i + 1]) * level[i + 1] for i in range(len(level) - 1)]
    first = [2 * (ratio(linear[i], k[i + 2] - k[i]) - ratio(linear[i + 1], k[i + 3] - k[i + 1])) for i in range(len(linear) - 1)]
    return [3 * (ratio(first[i], k[i + 3] - k[i]) - ratio(first[i + 1], k[i + 4] - k[i + 1])) for i in range(len(first) - 1)]


def _numeric(name: str, schema: T.StructType, used: set[str]) -> Column:
    if name not in schema.names:
        raise DecompositionError(f"no column {name!r}")
    if not isinstance(schema[name].dataType, T.NumericType):
        raise DecompositionError(f"column {name!r} is not numeric")
    used.add(name)
    return F.col(f"`{name}`").cast("double")


def _variable(text: str, schema: T.StructType) -> tuple[str, bool]:
    """The name of a variable and whether it is a factor (``factor(x)``, a string or a boolean)."""
    m = re.fullmatch(r"(?:as\.)?factor\((.*)\)", text)
    name = (m[1] if m else text).strip().strip("`")
    kind = schema[name].dataType if name in schema.names else None
    return name, bool(m) or isinstance(kind, (T.StringType, T.BooleanType))


def parse_terms(text: str, schema: T.StructType, response: str) -> list[frozenset[str]]:
    """The right side's terms as sets of variables, main effects first, in order of appearance."""
    terms: list[frozenset[str]] = []
    for part in _split(text, "+"):
        if "-" in re.sub(r"\(.*\)", "", part):
            raise DecompositionError("terms can't be taken out and the intercept must stay")
        if part in ("", "1"):
            continue
        if part == "0":
            raise DecompositionError("the intercept must stay")
        if part.startswith("offset("):
            raise DecompositionError("offsets are not supported")
        if part == ".":
            terms += [frozenset([f"`{n}`"]) for n in schema.names if n != response.strip("`")]
            continue
        factors = _split(part, "*")
        for mask in sorted(range(1, 2 ** len(factors)), key=lambda m: (bin(m).count("1"), m)):
            chosen = [f for k, f in enumerate(factors) if mask >> k & 1]
            terms.append(frozenset(v for f in chosen for v in _split(f, ":")))
    seen = list(dict.fromkeys(terms))
    return sorted(seen, key=lambda t: (len(t), seen.index(t)))


def compile_formula(formula: str, data: DataFrame) -> Design:
    """Compile against the unfiltered frame: levels are those of all its rows."""
    sides = _split(formula, "~")
    if len(sides) != 2 or not sides[0]:
        raise DecompositionError("a formula is of the form y ~ x")
    schema, used = data.schema, set()
    response = _arithmetic(sides[0], schema, used)
    terms = parse_terms(sides[1], schema, sides[0])
    variables = list(dict.fromkeys(v for t in terms for v in sorted(t, key=sides[1].find)))
    factors = {v: _variable(v, schema)[0] for v in variables if _variable(v, schema)[1]}
    levels = _levels(data, sorted(set(factors.values())))
    wide = {v: found for v in variables if v not in factors and (found := _wide(v, data, schema, used))}
    used |= set(factors.values())
    columns: list[tuple[str, Column]] = [(INTERCEPT, F.lit(1.0))]
    present = {frozenset(), *terms}
    for term in terms:
        pieces = []
        for v in sorted(term, key=sides[1].find):
            if v in factors:
                name = factors[v]
                kept = levels[name][1:] if term - {v} in present else levels[name]
                pieces.append([(f"{v.strip('`')}{level}", F.when(F.col(f"`{name}`").cast("string") == level.lower() if isinstance(schema[name].dataType, T.BooleanType) else F.col(f"`{name}`").cast("string") == level, 1.0).otherwise(0.0)) for level in kept])
            elif v in wide:
                parts, is_factor = wide[v]
                kept = parts[1:] if is_factor and term - {v} in present else parts
                pieces.append([(f"{v}{suffix}", column) for suffix, column in kept])
            else:
                pieces.append([(v.strip("`"), _arithmetic(v, schema, used))])
        for combination in product(*pieces):
            column = combination[0][1]
            for _, more in combination[1:]:
                column = column * more
            columns.append((":".join(n for n, _ in combination), column))
    return Design(response.cast("double"), tuple(columns), tuple(sorted(used)))


def _levels(data: DataFrame, names: list[str]) -> dict[str, list[str]]:
    out = {}
    for name in names:
        boolean = isinstance(data.schema[name].dataType, T.BooleanType)
        rows = data.select(F.col(f"`{name}`").cast("string").alias("v")).where("v is not null").distinct().limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise DecompositionError(f"{name!r} has more than {MAX_LEVELS} levels")
        out[name] = sorted(r["v"].upper() if boolean else r["v"] for r in rows)
    return out
