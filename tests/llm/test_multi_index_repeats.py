"""Operator 6 where every id is repeated."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import multiindex


@pytest.mark.parametrize("times", [2, 50])
def test_every_id_repeated(spark, times):
    x = np.random.default_rng(9).normal(size=(120, 8)).round(3)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    got = defaultdict(list)
    for r in multiindex.search(d, F.col("vec_id") % 20 == 0, centroids=4, probe=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 120, 20):
        s = x @ x[q]
        assert got[q] == sorted((i for i in range(120) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
