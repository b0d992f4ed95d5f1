"""The loss selector's fits read written rows, not the matches again."""

from pyspark.ml.regression import GBTRegressor

from hindsight.operators import routing


def test_fits_read_written_rows(spark, monkeypatch):
    plans, fit = [], GBTRegressor.fit

    def kept(self, df, *a):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, df, *a)

    monkeypatch.setattr(GBTRegressor, "fit", kept)
    routing.r4(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Window" in p or "Join" in p for p in plans)
