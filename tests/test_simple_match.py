"""The simple matcher's bins against every log on every route."""

import numpy as np
from pyspark.sql import functions as F

from trenchline.operators import candidates


def score(log, route):
    (start, end), (lo, hi, name) = log, route
    bore, feet = end - start, hi - lo
    out = max(0.0, min(end, hi) - max(start, lo)) / bore * 60 if bore > 0 else 0.0
    out += max(0.0, 30 - abs(feet - bore) / feet * 30) if feet > 0 else 0.0
    return out + (10 if name else 0)


def test_bins_find_the_best_route_of_all(spark):
    rng = np.random.default_rng(12)
    routes = [(f"p{i % 3}", f"r{i:03d}", float(rng.choice([0, 0, 0, 100])), float(np.round(np.exp(rng.uniform(0, 9)))), str(rng.choice(["", "main"]))) for i in range(400)]
    routes += [("p0", "same_b", 0.0, 500.0, "x"), ("p0", "same_a", 0.0, 500.0, "y"), ("p1", "empty", 50.0, 50.0, "z"), ("p2", "no_name", 0.0, 800.0, None)]
    logs = [(f"p{i % 4}", f"f{i}", s := float(np.round(rng.uniform(0, 2000))), s + float(np.round(rng.choice([0.0, 1.0]) * rng.uniform(0, 3000)))) for i in range(300)] + [("p0", "exact", 0.0, 500.0)]
    found = candidates.simple_match(spark.createDataFrame(logs, "project_id string, source_file string, start_ft double, end_ft double"),
                                    spark.createDataFrame(routes, "project_id string, route_id string, start_station double, end_station double, route_name string"))
    want = {}
    for p, f, start, end in logs:
        own = [(-round(score((start, end), (lo, hi, name)), 6), r, hi) for q, r, lo, hi, name in routes if q == p]
        if own:
            want[p, f] = min(own)
    got = {(r.project_id, r.source_file): r for r in found.collect()}
    assert set(got) == set(want)
    for key, (negative, route, end) in want.items():
        r = got[key]
        assert (r.route_id, r.end_station) == (route, end) and abs(r.score + negative) < 1e-5 and r.status == ("matched" if -negative >= 40 else "rejected")
    assert got["p0", "exact"].route_id == "same_a"


def test_few_bins_stay_open(spark):
    """A thousand routes of all lengths: a log meets a small part of them."""
    routes = spark.range(1000).selectExpr("'p' as project_id", "id as route_id", "0.0D as start_station", "double(10 + id * 7) as end_station", "'n' as route_name")
    logs = spark.range(50).selectExpr("'p' as project_id", "string(id) as source_file", "0.0D as start_ft", "double(100 + id * 100) as end_ft")
    found = candidates.simple_match(logs, routes)
    found.collect()
    assert found.count() == 50 and found.where(F.col("score") < 99).count() == 0
