"""Fixed output schemas. The columns and their order are a contract."""

from __future__ import annotations

SCHEMA_VERSION = "1.1"

# Column names and order of the outputs.
DECOMPOSITION = (
    "model string, solver string, quantile double, effect string, estimate double, identified boolean, std_error double, "
    "pointwise_lower double, pointwise_upper double, uniform_lower double, uniform_upper double, bootstrap_reps int, bootstrap_reps_effective int, alpha double"
)
MARGINALIZATION = (
    "distribution string, method string, passes int, histogram_bins int, candidate_draws long, estimated_matrix_mb double, boundary_quantiles int, "
    "identified_cdf_max double, dr_noncrossing string, dr_raw_crossing_pairs int, dr_raw_max_crossing double, dr_out_of_bounds_values int, "
    "dr_max_bound_adjustment double, dr_corrected_crossing_pairs int, dr_max_adjustment double"
)
OBSERVED = (
    "quantile double, reference_observed double, reference_model double, counterfactual_reference_structure_comparison_X double, "
    "comparison_observed double, comparison_model double"
)
CROSSING = (
    "distribution string, rows long, quantile_pairs double, crossing_rows long, crossing_row_share double, weighted_crossing_row_share double, "
    "crossing_pairs long, crossing_pair_share double, max_crossing double, mean_crossing double, tolerance double, correction string, stage string"
)
FUNCTIONAL = (
    "effect string, test string, null_value double, quantile_min double, quantile_max double, quantiles_tested int, bootstrap_reps int, "
    "ks_statistic double, ks_p_value double, cms_statistic double, cms_p_value double"
)
EFFECTS = ("structure", "composition", "total")
DISTRIBUTIONS = ("reference_model_X0", "reference_model_X1_counterfactual", "comparison_model_X1")


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
