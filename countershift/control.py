"""The control record: every tuning argument with its default and its rule."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from countershift import checks
from countershift.errors import BackendUnavailableError, DecompositionError

SCHEMES = ("counterfactual", "empirical", "multiplier")


@dataclass(frozen=True)
class Control:
    """Validated on construction. ``full_grid`` and ``grid`` are derived: midpoints, and midpoints inside the trimming."""

    nreg: int = 100
    trimming: float = 0.005
    reported_quantiles: tuple[float, ...] = tuple(k / 10 for k in range(1, 10))
    alpha: float = 0.05
    weighted_bootstrap: bool | None = None
    bootstrap_scheme: str = "counterfactual"
    legacy_qr_shift: bool = True
    legacy_weighted_quantile: bool = False
    qr_precondition: bool = True
    onestep_first_solver: str = "auto"
    onestep_bandwidth: str = "hall_sheather"
    qr_bootstrap_engine: str = "standard"
    robust_se: bool = False
    bootstrap_max_retries: int = 2
    bootstrap_progress: bool = False
    marginal_method: str = "auto"
    marginal_chunk_rows: int = 50_000
    marginal_matrix_max_mb: float = 512.0
    marginal_histogram_bins: int = 262_144
    marginal_candidate_max: int = 2_000_000
    crossing_diagnostics: bool = True
    crossing_tolerance: float = 1e-8
    quantile_noncrossing: str = "none"
    cqr_right: bool = False
    cqr_nsteps: int = 3
    cqr_first_cut: float = 0.1
    cqr_later_cut: float = 0.05
    #: Conditional quantiles that censoring leaves unidentified: an error, or lost draws beyond the identified ones of their row.
    cqr_boundary: str = "error"
    cox_boundary: str = "na"
    linear_backend: str = "auto"
    dr_backend: str = "auto"
    dr_workers: int = 1
    dr_warm_start: bool = True
    dr_maxit: int = 100
    dr_tolerance: float = 1e-8
    dr_precondition: bool = True
    gpu_backend: str = "cpu"
    gpu_precision: str = "float64"
    gpu_python: str | None = None
    gpu_python_path: str | None = None
    gpu_module_path: str | None = None
    gpu_block_columns: int = 16
    gpu_qr_rho: float = 1.0
    gpu_qr_maxit: int = 5000
    gpu_qr_tolerance: float = 1e-6
    gpu_qr_allow_nonconvergence: bool = False
    dr_noncrossing: str = "cummax"
    #: Group matrices up to this size are fitted in one process; beyond it every step is a pass over the executors' blocks.
    kernel_max_mb: float = 64.0
    full_grid: tuple[float, ...] = field(init=False)
    grid: tuple[float, ...] = field(init=False)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("nreg", checks.integer("nreg", self.nreg, 3))
        put("trimming", checks.number("trimming", self.trimming, least=0, below=0.5))
        put("reported_quantiles", checks.probabilities("reported_quantiles", self.reported_quantiles))
        checks.number("alpha", self.alpha, above=0, below=1)
        checks.choice("bootstrap_scheme", self.bootstrap_scheme, SCHEMES)
        if self.weighted_bootstrap is not None:
            meant = "counterfactual" if checks.flag("weighted_bootstrap", self.weighted_bootstrap) else "empirical"
            if self.bootstrap_scheme not in ("counterfactual", meant):
                raise DecompositionError("weighted_bootstrap contradicts bootstrap_scheme")
            warnings.warn(f"weighted_bootstrap is deprecated; use bootstrap_scheme={meant!r}", DeprecationWarning, stacklevel=3)
            put("bootstrap_scheme", meant)
        for name in (
            "legacy_qr_shift", "legacy_weighted_quantile", "qr_precondition", "robust_se", "bootstrap_progress", "crossing_diagnostics",
            "cqr_right", "dr_warm_start", "dr_precondition", "gpu_qr_allow_nonconvergence",
        ):
            checks.flag(name, getattr(self, name))
        checks.choice("onestep_bandwidth", self.onestep_bandwidth, ("hall_sheather", "bofinger"))
        checks.choice("qr_bootstrap_engine", self.qr_bootstrap_engine, ("standard", "xy_preprocess", "onestep", "auto"))
        checks.choice("marginal_method", self.marginal_method, ("auto", "matrix", "chunked"))
        checks.choice("quantile_noncrossing", self.quantile_noncrossing, ("none", "rearrange"))
        checks.choice("cox_boundary", self.cox_boundary, ("na", "error", "cap"))
        checks.choice("cqr_boundary", self.cqr_boundary, ("error", "na"))
        checks.choice("dr_noncrossing", self.dr_noncrossing, ("cummax", "rearrange", "isotonic", "none"))
        checks.choice("gpu_precision", self.gpu_precision, ("float64", "float32"))
        checks.choice("gpu_backend", self.gpu_backend, ("cpu", "auto", "cuda"))
        if self.gpu_backend == "cuda" or self.dr_backend == "cuda":
            raise BackendUnavailableError("no CUDA device is used by this engine")
        for name, least in (
            ("bootstrap_max_retries", 0), ("marginal_chunk_rows", 1), ("marginal_histogram_bins", 256), ("marginal_candidate_max", 1),
            ("cqr_nsteps", 3), ("dr_workers", 1), ("dr_maxit", 1), ("gpu_block_columns", 1), ("gpu_qr_maxit", 1),
        ):
            put(name, checks.integer(name, getattr(self, name), least))
        checks.number("crossing_tolerance", self.crossing_tolerance, least=0)
        for name in ("marginal_matrix_max_mb", "dr_tolerance", "gpu_qr_rho", "gpu_qr_tolerance", "kernel_max_mb"):
            checks.number(name, getattr(self, name), above=0)
        for name in ("cqr_first_cut", "cqr_later_cut"):
            checks.number(name, getattr(self, name), above=0, below=1)
        if self.legacy_weighted_quantile and self.marginal_method == "chunked":
            raise DecompositionError("the legacy weighted quantile needs the matrix method")
        full = tuple((j - 0.5) / self.nreg for j in range(1, self.nreg + 1))
        put("full_grid", full)
        put("grid", tuple(t for t in full if self.trimming <= t <= 1 - self.trimming))
        if not self.grid:
            raise DecompositionError("trimming removes every conditional quantile")

    def for_model(self, model: str) -> tuple[float, ...]:
        """Conditional quantiles that a model is fitted on: only quantile regression is trimmed."""
        return self.grid if model == "qr" else self.full_grid
