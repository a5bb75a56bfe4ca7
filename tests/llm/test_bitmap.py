"""The hint of telling words reaches the driver as bits, not as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specimen_spark.llm import contrast


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_the_bitmap_is_made_by_tasks(spark, n):
    words = spark.range(n).select(F.xxhash64("id").alias("word"))
    bits = np.zeros(1 << contrast.BITMAP, bool)
    bits[[r[0] & ((1 << contrast.BITMAP) - 1) for r in words.collect()]] = True
    assert np.array_equal(contrast.bitmap(words), np.packbits(bits))
