"""Command line: decompose, benchmark, scaling, simulate."""

from __future__ import annotations

import argparse
import os
from dataclasses import fields

from countershift.control import Control
from countershift.errors import DecompositionError


def as_bool(text: str) -> bool:
    if text.lower() in ("true", "t", "yes", "1"):
        return True
    if text.lower() in ("false", "f", "no", "0"):
        return False
    raise argparse.ArgumentTypeError(f"not a truth value: {text}")


def distinct_paths(paths: dict[str, str | None]) -> None:
    """No two paths are the same place or lie inside each other's file."""
    real = {k: v.rstrip("/") if "://" in v else os.path.realpath(v) for k, v in paths.items() if v}
    names = list(real)
    for i, a in enumerate(names):
        for b in names[:i]:
            if real[a] == real[b]:
                raise DecompositionError(f"--{a} and --{b} are the same path")
    for k, v in real.items():
        parent = os.path.dirname(v)
        while parent and parent != os.path.dirname(parent):
            if os.path.isfile(parent):
                raise DecompositionError(f"--{k} lies below the file {parent}")
            parent = os.path.dirname(parent)


def floats(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def control_fields() -> list:
    """Every tuning argument but those that all commands have or that go by another name."""
    return [f for f in fields(Control) if f.init and f.name not in ("nreg", "reported_quantiles")]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="countershift", allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)

    def data_arguments(p):
        p.add_argument("--data", required=True)
        p.add_argument("--format")
        p.add_argument("--formula", required=True)
        p.add_argument("--group", required=True)
        p.add_argument("--weights")
        p.add_argument("--output", required=True)
        p.add_argument("--seed", type=int, default=1)
        p.add_argument("--nreg", type=int, default=100)

    p = commands.add_parser("decompose", allow_abbrev=False)
    data_arguments(p)
    p.add_argument("--model", default="qr")
    p.add_argument("--solver")
    p.add_argument("--bootstrap-reps", type=int, default=0)
    p.add_argument("--checkpoint-dir")
    p.add_argument("--censoring")
    p.add_argument("--event")
    p.add_argument("--quantiles", type=floats, default=Control().reported_quantiles)
    for f in control_fields():
        p.add_argument(f"--{f.name.replace('_', '-')}", type=as_bool if "bool" in f.type else {"int": int, "float": float}.get(f.type, str), default=f.default)
    p = commands.add_parser("benchmark", allow_abbrev=False)
    data_arguments(p)
    p.add_argument("--solvers", default="br,fn,qfnb,pfnb")
    p.add_argument("--repetitions", type=int, default=3)
    p = commands.add_parser("scaling", allow_abbrev=False)
    data_arguments(p)
    p.add_argument("--solvers", default="br,pfnb")
    p.add_argument("--sizes", default="1000,2000")
    p.add_argument("--checkpoint")
    p = commands.add_parser("simulate", allow_abbrev=False)
    p.add_argument("--output", required=True)
    p.add_argument("--replications", type=int, default=10)
    p.add_argument("--n-per-group", type=int, default=300)
    p.add_argument("--bootstrap-reps", type=int, default=0)
    p.add_argument("--nreg", type=int, default=19)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--checkpoint-dir")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    distinct_paths({k: getattr(a, k.replace("-", "_"), None) for k in ("data", "output", "checkpoint-dir", "checkpoint")})
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("countershift").getOrCreate()
    if a.command == "simulate":
        from countershift.plans.simulate import simulate_counterfactual_validation, write_simulation_validation

        out = simulate_counterfactual_validation(spark, a.replications, a.n_per_group, nreg=a.nreg, bootstrap_reps=a.bootstrap_reps, seed=a.seed, checkpoint_dir=a.checkpoint_dir)
        print("\n".join(write_simulation_validation(out, a.output)))
        return 0
    from countershift.sources.readers import read_table

    data = read_table(spark, a.data, a.format)
    if a.command == "decompose":
        from countershift.plans.decompose import counterfactual_decompose
        from countershift.result import describe, write_outputs

        control = Control(nreg=a.nreg, reported_quantiles=a.quantiles, **{f.name: getattr(a, f.name) for f in control_fields()})
        censoring = a.censoring
        if censoring is not None and censoring not in data.columns:
            censoring = float(censoring)
        out = counterfactual_decompose(a.formula, data, a.group, a.weights, a.model, a.solver, control, a.bootstrap_reps, checkpoint_dir=a.checkpoint_dir, seed=a.seed, censoring=censoring, event=a.event)
        write_outputs(out, a.output)
        print(describe(out))
        return 0
    from countershift.plans.benchmark import benchmark_qr_scaling, benchmark_qr_solvers_repeated
    from countershift.sources.sinks import write_together

    solvers = tuple(a.solvers.split(","))
    if a.command == "benchmark":
        raw, table = benchmark_qr_solvers_repeated(a.formula, data, a.group, a.weights, solvers, solvers[0], Control(nreg=a.nreg), seed=a.seed, repetitions=a.repetitions)
    else:
        sizes = tuple(int(x) for x in a.sizes.split(","))
        raw, table = benchmark_qr_scaling(a.formula, data, a.group, a.weights, solvers, solvers[0], {"nreg": a.nreg}, sizes, a.seed, checkpoint_path=a.checkpoint)
    files = {f"{a.command}.csv": raw, f"{a.command}_summary.csv": table}
    write_together(a.output, files, lambda stage: [t.to_csv(os.path.join(stage, n), index=False) for n, t in files.items()], files)
    print(table.to_string())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
