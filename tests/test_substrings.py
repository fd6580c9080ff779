"""Substring search through the index against looking at every pair."""

import numpy as np

from trenchline.operators import corridors, substrings


def test_holders_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    letters = list("abcé -1")
    texts = [(f"p{i % 3}", None if i % 41 == 0 else "".join(rng.choice(letters, rng.integers(0, 25)))) for i in range(400)]
    words = [(f"p{i % 4}", "".join(rng.choice(letters, rng.integers(0, 7)))) for i in range(300)]
    found = substrings.holders(spark.createDataFrame(words, "k string, w string"), spark.createDataFrame(texts, "k string, t string"), ["k"], "w", "t")
    want = {(k, w, t) for k, w in words for own, t in texts if w and own == k and t is not None and w in t}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(len(w) < 3 for _, w, _ in want) and any(len(w) > 4 for _, w, _ in want)


def test_anchor_points_equal_all_pairs(spark):
    best = spark.createDataFrame([("p", "a", ["E STONE ST"], ["AP-12", "PROP. SPLICE POINT 7"]), ("p", "b", [], ["VACANT HDPE"]), ("q", "c", ["N OAK LN"], []), ("q", "d", [], [])],
                                 "project_id string, source_file string, streets array<string>, labels array<string>")
    names = ["Splice Point 7", "stone yard", "AP-12 closure", "Pole", "hdpe vacant 3", "oakland", "Milestone", "LN 4", ""]
    points = spark.createDataFrame([(p, n, "Nodes", "other", 30.0 + i, -96.0) for p in "pq" for i, n in enumerate(names)],
                                   "project_id string, name string, folder_path string, role string, lat double, lon double")
    words = corridors.anchor_words(best).collect()
    hay = {(r.project_id, r.lat): f"{r.name} {r.folder_path} {r.role}".lower() for r in points.collect()}
    want = {}
    for w in words:
        for (project, lat), text in hay.items():
            if project == w.project_id and w.word in text:
                want.setdefault((w.project_id, w.source_file), set()).add(lat)
    found = {(r.project_id, r.source_file): {a.lat for a in r.anchors} for r in corridors.anchor_points(best, points).collect()}
    assert found == want and len(want) >= 3
    plan = corridors.anchor_points(best, points)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
