"""User-defined solvers and backends.

A fit is a function of whole matrices, or a :class:`Mergeable`: rounds of sums
over blocks of rows, which run where the rows lie. What is mergeable is tried
when it is registered: blocks in another number or order must give the same
coefficients.

A function is frozen when it is registered: it is pickled by value, so later
changes to what it refers to don't reach it, and its bytes name it in
checkpoint signatures.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from countershift.errors import DecompositionError

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9._]*")

# The built-in solvers and backends with their properties.
QR_SOLVERS = {
    "br": ("vertex polish", True, False), "fn": ("interior point", True, False), "pfn": ("preprocessed interior point", True, False),
    "qfnb": ("interior point over the process", True, True), "pfnb": ("preprocessed interior point over the process", True, True),
    "proqreg": ("process preprocessing, vertex polish", True, True), "profn": ("process preprocessing, interior point", True, True),
    "onestep": ("one Newton step per quantile", False, True), "cuda_admm": ("alternating directions", False, True),
}
LINEAR_BACKENDS = ("qr", "chol", "fastglm")
DR_BACKENDS = ("glm", "fastglm", "speedglm", "cuda")


@dataclass(frozen=True)
class Mergeable:
    """A fit as rounds over blocks: ``partial(X, targets, weights, state)`` of each, ``merge`` of two, ``finish(sums, state)`` -> (state, done).

    ``targets`` has a column for every fit of the same rows (quantile solvers: one
    column, the outcome). ``start(p, m, what)`` makes the first state for ``m``
    fits of ``p`` columns; ``what`` are a solver's quantiles, a distribution
    backend's model, else None. ``coefficients(state)`` are p x fits.
    """

    partial: Callable
    merge: Callable
    finish: Callable
    start: Callable = lambda p, m, what: None
    coefficients: Callable = lambda state: state
    rounds: int = 100

    def run(self, reduce: Callable, p: int, m: int, what, name: str) -> np.ndarray:
        """``reduce(state)`` makes a pass."""
        state = self.start(p, m, what)
        for _ in range(self.rounds):
            state, done = self.finish(reduce(state), state)
            if done:
                break
        else:
            raise DecompositionError(f"{name!r} was not done after {self.rounds} rounds")
        out = np.asarray(self.coefficients(state), float)
        out = out[:, None] if out.ndim == 1 else out
        if out.shape != (p, m) or not np.isfinite(out).all():
            raise DecompositionError(f"{name!r} returned no finite coefficients of the right shape")
        return out

    def check(self, kind: str, name: str) -> None:
        """One block, three, and three in another order must give the same."""
        rng = np.random.default_rng(0)
        x = np.column_stack([np.ones(90), rng.normal(size=(90, 2))])
        y, w = x @ [1.0, 0.5, -0.3] + rng.normal(size=90), rng.uniform(0.5, 2, 90)
        what = {"solver": np.array([0.25, 0.5, 0.75]), "distribution": "logit"}.get(kind)
        targets = (y[:, None] <= np.quantile(y, [0.3, 0.6])).astype(float) if kind == "distribution" else y[:, None]
        found = []
        for cuts, order in (((0, 90), (0,)), ((0, 20, 55, 90), (0, 1, 2)), ((0, 20, 55, 90), (2, 0, 1))):

            def reduce(state, cuts=cuts, order=order):
                parts = [self.partial(x[cuts[k] : cuts[k + 1]], targets[cuts[k] : cuts[k + 1]], w[cuts[k] : cuts[k + 1]], state) for k in order]
                out = parts[0]
                for part in parts[1:]:
                    out = self.merge(out, part)
                return out

            found.append(self.run(reduce, 3, 3 if kind == "solver" else targets.shape[1], what, name))
        if not all(np.allclose(f, found[0], rtol=1e-7, atol=1e-7) for f in found):
            raise DecompositionError(f"{name!r} depends on how rows are cut into blocks, so it is not mergeable")


@dataclass(frozen=True)
class Extension:
    name: str
    frozen: bytes
    exact: bool = True
    process_aware: bool = False
    description: str = ""
    version: str = ""
    dependencies: tuple[str, ...] = ()
    kind: str = "solver"
    mergeable: bytes | None = None
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def fit(self) -> Callable:
        if "fit" not in self._cache:
            self._cache["fit"] = cloudpickle.loads(self.frozen)
        return self._cache["fit"]

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.frozen + self.version.encode() + (self.mergeable or b"")).hexdigest()

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    @property
    def by_blocks(self) -> Mergeable:
        if "mergeable" not in self._cache:
            self._cache["mergeable"] = cloudpickle.loads(self.mergeable)
        return self._cache["mergeable"]

    def runs_by_blocks(self, blocks) -> bool:
        """Whether a fit of these blocks goes by passes: rows that lie on executors, or no function of whole matrices."""
        return self.mergeable is not None and (not self.frozen or not hasattr(blocks, "block"))

    def on_blocks(self, blocks, targets: Callable, m: int, what=None) -> np.ndarray:
        """Coefficients (p x m) by passes over the rows where they lie; ``targets(block)`` has their columns."""
        own = self

        def reduce(state):
            # the pieces travel as this extension's frozen bytes, not by the name of a module that executors may lack
            return blocks.reduce(lambda b: own.by_blocks.partial(b.x, targets(b), b.w, state), lambda a, b: own.by_blocks.merge(a, b))

        return self.by_blocks.run(reduce, blocks.p, m, what, self.name)

    def solve(self, x, z, w) -> np.ndarray:
        """A linear backend's checked coefficients."""
        out = self.fit(x, z, w)
        b = np.asarray(out["coefficients"] if isinstance(out, dict) else out, float).ravel()
        if b.shape != (x.shape[1],) or not np.isfinite(b).all():
            raise DecompositionError(f"backend {self.name!r} returned no finite coefficients")
        return b

    def process(self, x, y, w, taus) -> tuple[np.ndarray, dict]:
        """A solver's checked coefficient matrix and its report."""
        out = self.fit(x, y, w, np.asarray(taus, float))
        report = {k: v for k, v in out.items() if k != "coefficients"} if isinstance(out, dict) else {}
        b = np.asarray(out["coefficients"] if isinstance(out, dict) else out, float)
        b = b.reshape(x.shape[1], -1) if b.ndim == 1 else b
        if b.shape != (x.shape[1], len(taus)) or not np.isfinite(b).all():
            raise DecompositionError(f"solver {self.name!r} returned no finite coefficients of the right shape")
        return b, report


solvers: dict[str, Extension] = {}
backends: dict[tuple[str, str], Extension] = {}


def _freeze(name: str, fit: Callable | None, taken, overwrite: bool, present: bool, mergeable: Mergeable | None = None, kind: str = "solver") -> tuple[str, bytes, bytes | None]:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise DecompositionError("a name begins with a letter and holds letters, digits, dots and underscores")
    name = name.lower()
    if name in taken or name == "auto":
        raise DecompositionError(f"{name!r} is built in")
    if present and not overwrite:
        raise DecompositionError(f"{name!r} is registered already")
    if mergeable is not None:
        if not isinstance(mergeable, Mergeable) or not all(map(callable, (mergeable.partial, mergeable.merge, mergeable.finish, mergeable.start, mergeable.coefficients))):
            raise DecompositionError("mergeable must be a Mergeable of functions")
        mergeable.check(kind, name)
        return name, b"" if fit is None else _frozen(name, fit), _frozen(name, mergeable, mergeable.partial)
    return name, _frozen(name, fit), None


def _frozen(name: str, fit, owner_of=None) -> bytes:
    """Pickled by value: what it refers to later changes nothing, and executors need not have its module."""
    if owner_of is None and not callable(fit):
        raise DecompositionError("fit must be callable")
    module = getattr(owner_of or fit, "__module__", None)
    try:
        import sys

        owner = sys.modules.get(module)
        by_value = owner is not None and module not in ("__main__", "builtins") and not module.startswith(("numpy", "countershift"))
        if by_value:
            cloudpickle.register_pickle_by_value(owner)
        try:
            return cloudpickle.dumps(fit)
        finally:
            if by_value:
                cloudpickle.unregister_pickle_by_value(owner)
    except (TypeError, ValueError, AttributeError) as e:
        raise DecompositionError(f"{name!r} can't be sent to executors: {e}") from None


def register_qr_solver(name, fit, exact: bool, process_aware: bool = False, description: str = "", overwrite: bool = False, dependencies=(), version: str = "", mergeable: Mergeable | None = None) -> None:
    """``fit(X, y, weights, taus)`` gives a p x ntau matrix, or a dict with ``coefficients``; None where ``mergeable`` does it all."""
    name, frozen, blocks = _freeze(name, fit, QR_SOLVERS, overwrite, name.lower() in solvers, mergeable, "solver")
    solvers[name] = Extension(name, frozen, exact, process_aware, description, version, tuple(dependencies), "solver", blocks)


def unregister_qr_solver(name: str, quiet: bool = False) -> bool:
    found = solvers.pop(name.lower(), None) is not None
    if not found and not quiet:
        raise DecompositionError(f"no solver {name!r}")
    return found


def register_conditional_backend(name, type, fit, objective_preserving: bool = True, description: str = "", overwrite: bool = False, dependencies=(), version: str = "", mergeable: Mergeable | None = None) -> None:
    """linear: ``fit(X, y, weights)``; distribution: ``fit(X, response, weights, model, start, maxit, tolerance)``; None where ``mergeable`` does it all."""
    if type not in ("linear", "distribution"):
        raise DecompositionError("type must be linear or distribution")
    name, frozen, blocks = _freeze(name, fit, LINEAR_BACKENDS if type == "linear" else DR_BACKENDS, overwrite, (type, name.lower()) in backends, mergeable, type)
    backends[type, name] = Extension(name, frozen, objective_preserving, False, description, version, tuple(dependencies), type, blocks)


def unregister_conditional_backend(name: str, type: str, quiet: bool = False) -> bool:
    found = backends.pop((type, name.lower()), None) is not None
    if not found and not quiet:
        raise DecompositionError(f"no {type} backend {name!r}")
    return found


def qr_solver_registry(spark: SparkSession) -> DataFrame:
    rows = [(n, *v) for n, v in QR_SOLVERS.items()] + [(e.name, e.description or "custom", e.exact, e.process_aware) for e in solvers.values()]
    return spark.createDataFrame(rows, "solver string, implementation string, exact boolean, process_aware boolean")


def conditional_backend_registry(spark: SparkSession) -> DataFrame:
    rows = [(m, b, "least squares", True, None) for m in ("loc", "locsca", "lpm") for b in LINEAR_BACKENDS]
    rows += [(m, b, "batched iteratively reweighted least squares", True, None) for m in ("logit", "probit", "cloglog") for b in DR_BACKENDS if b != "cuda"]
    rows += [(t, e.name, e.description or "custom", e.exact, None) for (t, _), e in backends.items()]
    return spark.createDataFrame(rows, "model string, backend string, implementation string, objective_preserving boolean, optional_package string")


def active_fingerprint(solver: str, linear: str, dr: str) -> dict[str, str]:
    """Fingerprints of the extensions that a run uses."""
    used = {f"solver:{solver}": solvers.get(solver), f"linear:{linear}": backends.get(("linear", linear)), f"distribution:{dr}": backends.get(("distribution", dr))}
    return {k: e.fingerprint for k, e in used.items() if e is not None}


def snapshot() -> tuple[dict, dict]:
    return dict(solvers), dict(backends)


def restore(state: tuple[dict, dict]) -> None:
    for own, given in zip((solvers, backends), state):
        own.clear()
        own.update(given)
