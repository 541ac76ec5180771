"""Power exponents: few jobs whatever the partitions, and counted values weigh as their rows."""

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import preprocess


def test_exponents_take_few_jobs_and_weigh_repeats(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.lognormal(size=3000), 1)
    df = spark.createDataFrame([(float(v), float(-v) if i % 2 else None) for i, v in enumerate(x)], "a double, b double").repartition(40)
    spark.sparkContext.setJobGroup("power", "power")
    found = preprocess._power_fits(df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("power")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) < 40  # one or two for each pass, not one for each partition and pass
    for c, values in (("a", x), ("b", -x[1::2])):
        lams = found[c] + np.array([-1e-3, 0, 1e-3])
        cost = [len(values) / 2 * np.log(preprocess.power(values, lam).var()) - (lam - 1) * (np.sign(values) * np.log1p(np.abs(values))).sum() for lam in lams]
        assert cost[1] < cost[0] and cost[1] < cost[2]
    assert preprocess._power_fits(df.select(F.lit(None).cast("double").alias("a"))) == {"a": 1.0}
