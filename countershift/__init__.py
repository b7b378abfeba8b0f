"""Counterfactual distribution and quantile decomposition on Spark."""

from countershift.control import Control
from countershift.control import Control as cf_control
from countershift.operators.qr import fit_weighted_qr
from countershift.plans.benchmark import benchmark_conditional_backends, benchmark_qr_scaling, benchmark_qr_solvers, benchmark_qr_solvers_repeated
from countershift.plans.decompose import Decomposition, counterfactual_decompose, functional_effect_tests
from countershift.registry import Mergeable, conditional_backend_registry, qr_solver_registry, register_conditional_backend, register_qr_solver, unregister_conditional_backend, unregister_qr_solver
from countershift.result import write_outputs
from countershift.result import write_outputs as write_cf_outputs
from countershift.plans.simulate import simulate_counterfactual_validation, write_simulation_validation

__version__ = "0.1.0"


def gpu_backend_status(python=None, python_path=None, module_path=None) -> dict:
    """No device is used by this engine; the fields say so."""
    return {"available": False, "reason": "this engine runs on Spark executors' processors only", "python": python, "module_path": module_path, "device": None, "cuda_version": None}


__all__ = [
    "Control", "Decomposition", "Mergeable", "benchmark_conditional_backends", "benchmark_qr_scaling", "benchmark_qr_solvers", "benchmark_qr_solvers_repeated", "cf_control", "conditional_backend_registry",
    "counterfactual_decompose", "fit_weighted_qr", "functional_effect_tests", "gpu_backend_status", "qr_solver_registry", "register_conditional_backend", "register_qr_solver",
    "simulate_counterfactual_validation", "unregister_conditional_backend", "unregister_qr_solver", "write_cf_outputs", "write_outputs", "write_simulation_validation",
]
