"""Hypotheses on routes without length, and the anchor check, through the real steps."""

from pyspark.sql import functions as F

from trenchline.operators import gates, windows

INPUTS = ("project_id string, group_id string, source_file string, tokens_key string, route_id string, route_name string, rank int, score double, length_ft double, total_ft double, "
          "min_station_ft double, span_ft double, chain array<double>, lats array<double>, lons array<double>, rel array<double>, "
          "station_rows array<struct<station_ft:double>>, sheets array<int>, route_sheets array<int>")


def hypothesis(group, route, rank, score, chain, stations):
    low = min(stations)
    return ("p", group, "f", "1", route, route, rank, score, float(chain[-1]) if chain else 0.0, float(chain[-1]) if chain else 0.0, low, max(stations) - low, chain,
            [30.0 + c / 364000 for c in chain], [-96.0] * len(chain), [s - low for s in stations], [(s,) for s in stations], [], [])


def test_routes_without_length_stay_as_bad_anchors(spark):
    line = [60.0 * i for i in range(11)]
    rows = [hypothesis("g1", "good", 1, 0.8, line, [100.0, 150.0, 200.0]), hypothesis("g1", "flat", 2, 0.5, [0.0, 0.0], [100.0, 150.0, 200.0]),
            hypothesis("g2", "empty", 1, 0.4, [], [100.0]), hypothesis("g3", "good", 1, 0.3, line, [10.0])]
    anchored = windows.anchor(spark.createDataFrame(rows, INPUTS))
    found = {(r.group_id, r.route_id): r for r in gates.validate(anchored).collect()}
    assert len(found) == 4
    for key in (("g1", "flat"), ("g2", "empty")):
        r = found[key]
        assert (r.anchor_method, r.anchor_strategy, r.start_ft, r.end_ft, r.window_score, r.n_windows) == ("invalid_route_geometry", "", 0.0, 0.0, 0.0, 0)
        assert (r.combined, r.c_anchor) == (r.score, "warn") and r.p_route_ft == []
    # stations that all fall on 0 ft fail first; a lone station is a bad anchor
    assert found["g1", "flat"].failure_class == "STATION_NORMALIZATION_ISSUE" and found["g1", "flat"].status == "fail"
    assert found["g2", "empty"].failure_class == "BAD_ANCHOR" and found["g2", "empty"].status == "warn" and found["g2", "empty"].confidence_label == "MEDIUM"
    good = found["g1", "good"]
    assert (good.anchor_method, good.c_anchor, good.anchor_rank) == ("true_sliding_window_segment_scorer", "pass", 1)
    assert found["g3", "good"].c_anchor == "pass" and found["g3", "good"].failure_class is None


def test_every_weak_strategy_warns(spark):
    line = [60.0 * i for i in range(11)]
    base = windows.anchor(spark.createDataFrame([hypothesis("g", "good", 1, 0.8, line, [100.0, 150.0, 200.0])], INPUTS))
    for strategy, want in ((None, "warn"), ("none", "warn"), ("full_route_fallback", "warn"), ("group_relative_origin", "warn"), ("balanced_span_search", "warn"), ("absolute_station_window", "pass")):
        r = gates.validate(base.withColumn("anchor_strategy", F.lit(strategy).cast("string"))).first()
        assert r.c_anchor == want and (r.failure_class == "BAD_ANCHOR") == (want == "warn")
