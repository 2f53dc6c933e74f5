"""Logistic regression against the same descent in numpy."""

import re

import numpy as np

from ladderflow.plans import catalog, graph_queries
from ladderflow.plans.proxies import ticks

catalog.load()
SF = "/root/testdata/sf0.001"


def test_logistic_training(spark):
    rows = [(r.value / 100, float(r.seq % 2), int(r.value > 50)) for r in ticks(spark, SF).collect()]
    x, y = np.array([[a, b, 1.0] for a, b, _ in rows]), np.array([c for *_, c in rows])
    weights = np.zeros(3)
    for _ in range(200):
        weights -= 0.1 * ((1 / (1 + np.exp(-x @ weights)) - y) @ x) / len(y)
    got = {r.feature: r.weight for r in catalog.QUERIES["logistic_training"](spark, SF).collect()}
    assert np.allclose([got["x1"], got["x2"], got["bias"]], weights, rtol=0, atol=1e-9)


def test_feasibility_is_dealt_by_its_rows(spark, monkeypatch):
    """Tasks grow in number with the table, not in size."""
    monkeypatch.setattr(graph_queries, "ROWS_A_TASK", 300)
    tasks = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300)
    plan = catalog.QUERIES["constraint_feasibility"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and len(re.findall(rf"hashpartitioning\(group_id#\w+, (?:idx|c_id)#\w+, {tasks}\)", plan)) >= 4
