"""F4 cqr_general fitted three quantiles and reported three; censoring leaves the lowest of a full grid unidentified, the rest is whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countershift import Control, counterfactual_decompose, queries
from countershift.errors import NotIdentifiedError
from countershift.operators.blocks import LocalBlocks
from countershift.operators.marginal import marginal_quantiles
from countershift.operators.models import Fit


def test_the_query_fits_the_default_grid(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries, "counterfactual_decompose", lambda *a, **k: seen.append(k["control"]) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        queries.QUERIES["cqr_general"](spark, "/root/testdata/sf0.01")
    assert seen[0].nreg == Control().nreg == 100 and seen[0].reported_quantiles == Control().reported_quantiles


@pytest.mark.parametrize("right", [False, True])
@pytest.mark.parametrize("chunked", [False, True])
def test_ranks_count_the_draws_that_are_not_known(right, chunked):
    """Against all draws, the lost ones set to anything their row allows."""
    rng = np.random.default_rng(3)
    x, w = np.column_stack([np.ones(50), rng.integers(0, 2, 50)]), rng.integers(1, 5, 50).astype(float)
    b = np.vstack([np.sort(rng.normal(size=20)), np.full(20, 0.3)])
    blocks, probs = LocalBlocks(x, np.zeros(50), w / w.mean()), np.arange(1, 20) / 20
    control = Control(marginal_method="chunked" if chunked else "matrix", marginal_histogram_bins=256)
    every, _ = marginal_quantiles(Fit("cqr", np.arange(20), b), blocks, probs, control)
    part = Fit("cqr", np.arange(16), b[:, :16], unidentified=(0, 4)) if right else Fit("cqr", np.arange(16), b[:, 4:], unidentified=(4, 0))
    found, row = marginal_quantiles(part, blocks, probs, control)
    seen = np.isfinite(found)
    np.testing.assert_allclose(found[seen], every[seen], rtol=1e-12)
    assert row["boundary_quantiles"] == (~seen).sum() and 8 <= seen.sum() < 19
    assert not (seen[-4:] if right else seen[:4]).any()


@pytest.mark.parametrize("mb", [64, 1e-6])
def test_grid_above_the_censoring(spark, mb):
    rows = spark.range(1200).select((F.col("id") % 2).cast("int").alias("g"), (F.col("id") % 3).cast("string").alias("f"), F.greatest(F.randn(1) + F.col("id") % 3 / 9 + 1, F.lit(0.0)).alias("y"))
    make = lambda **more: counterfactual_decompose("y ~ f", rows, "g", None, "cqr", "pfnb", Control(nreg=10, kernel_max_mb=mb, **more), censoring=0.0)
    with pytest.raises(NotIdentifiedError):
        make()
    out = make(cqr_boundary="na")
    lost = [f.unidentified[0] for f in out.point.fits]
    assert all(1 <= k <= 3 for k in lost) and [len(f.grid) for f in out.point.fits] == [10 - k for k in lost]
    known = np.isfinite(out.point.effects["total"])
    assert known[4:].all() and not known[0] and [r["identified"] for r in out.rows()][-9:] == list(known)


def test_equal_margins_stay_together(spark):
    """Cells whose margin is the cut itself were lost where an interpolation of equal values was rounded up: none but low quantiles are."""
    out = queries.QUERIES["cqr_general"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == 27 and all(r["identified"] for r in out if r["quantile"] > 0.25)
