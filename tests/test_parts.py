"""Windows of bounded reach give the same rows however finely a sport's order is cut into parts."""

import pytest

from hindsight.operators import windows
from hindsight.plans.queries import ORACLE_SQL, QUERIES

from .test_oracles import SF, duck, rows  # noqa: F401

NAMES = [
    "w9_rolling_mean_std", "w10_causal_slope", "w11_differences", "w12_future_loss", "w13_forward_change", "w14_causal_zscore", "w15_safety_gate", "w16_soft_routing",
    "w18_worst_window", "q11_regime", "q12_revision_metrics", "v5_stability", "v11_fold_research",
]


@pytest.mark.parametrize("name", NAMES)
def test_small_parts(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(windows, "PART", 7)
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_regime_at_its_threshold(spark, duck):  # noqa: F811
    """Ten values whose deviation is exactly 0.28 fall on the side that the SQL gives them."""
    runs = [[81, 67, 23, 73, 26, 78, 58, 9, 31, 4], [79, 13, 89, 12, 53, 82, 73, 25, 72, 72], [62, 89, 86, 70, 1, 70, 38, 68, 12, 54], [25, 78, 78, 23, 8, 87, 31, 18, 54, 18], [29, 13, 16, 23, 11, 89, 4, 56, 54, 75], [81, 87, 3, 72, 28, 90, 43, 32, 68, 36]]
    preds = [(100 * s + i, f"s{s}", i, 0.05 + k / 100) for s, run in enumerate(runs) for i, k in enumerate(run, 1)]
    df = spark.createDataFrame(preds, "match_id long, sport string, seq int, p1 double")
    sql = ORACLE_SQL["q11_regime"]
    duck.register("given", df.toPandas())
    want = duck.execute("WITH preds AS (SELECT * FROM given)" + sql[sql.index(", r AS ") :]).df()
    assert rows(windows.regimes(df).toPandas()) == rows(want)
