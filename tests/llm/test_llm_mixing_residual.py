import warnings

import pytest

from evalspark.llm import mixing


def test_contradicting_targets_are_reported(spark):
    cells = spark.createDataFrame([("=a", "=x", "=p", 3), ("=b", "=y", "=p", 1)], "s string, l string, t string, n long")
    even = {"topic": {"p": 1.0}}
    with pytest.warns(RuntimeWarning, match="source 0.3, lang "):
        mixing.rake(cells, targets=even | {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.5, "y": 0.5}}, max_sweeps=3)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        mixing.rake(cells, targets=even | {"source": {"a": 0.8, "b": 0.2}, "lang": {"x": 0.8, "y": 0.2}}, max_sweeps=3)
