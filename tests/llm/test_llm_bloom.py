import numpy as np
from pyspark.sql import functions as F

from newsflux.llm.bloom import MAX_BITS, MIN_BITS, Bloom, bits_for


def test_size_follows_the_keys():
    assert bits_for(0) == bits_for(1) == bits_for(10_000) == MIN_BITS and bits_for(10**12) == MAX_BITS
    assert all(b >= 10 * n and b & (b - 1) == 0 for n in (10**5, 10**6, 10**7, 10**8) for b in (bits_for(n),))


def test_keys_are_in_it_and_few_others_at_any_size(spark):
    for n in (0, 5, 30_000, 300_000):
        keys = spark.range(n).select(F.xxhash64("id").alias("k"))
        if n == 5:
            keys = keys.union(spark.createDataFrame([(None,)], "k long"))
        bloom = Bloom.of(keys, "k")
        inside = np.array([r.k for r in keys.limit(2000).collect() if r.k is not None], np.int64)
        others = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 200_000)
        assert bloom.has(inside).all() and bloom.has(others).mean() <= 0.03
        assert len(bloom.raw) * 8 == bits_for(n)
