"""Route chains against every combination, looked at one by one."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trenchline.operators import chains, corridors

POOL = ("project_id string, source_file string, place int, route_id string, route_role string, route_ft double, coords array<struct<lat:double,lon:double>>, "
        "locality double, box_share double, gate_ft double, role_bonus double, priority double, target_ft double")


def feet(a, b):
    return math.hypot(69 * (a[0] - b[0]), math.cos(math.radians((a[0] + b[0]) / 2)) * 69 * (a[1] - b[1])) * 5280


def centre(line):
    return sum(p[0] for p in line) / len(line), sum(p[1] for p in line) / len(line)


def may_link(a, b, link):
    ends_a, ends_b = (a[0], a[-1]), (b[0], b[-1])
    return (any(feet(p, q) <= link for p in ends_a for q in ends_b) or feet(centre(a), centre(b)) <= link * 1.45
            or any(feet(p, q) <= link * 1.1 for p in ends_a for q in b) or any(feet(p, q) <= link * 1.1 for p in ends_b for q in a))


def chains_by_hand(pool):
    target = pool[0]["target_ft"]
    link = max(90.0, min(240.0, target * 0.14 + 30))
    links = {(i, j) for i, j in combinations(range(len(pool)), 2) if may_link(pool[i]["coords"], pool[j]["coords"], link)}
    out = []
    for size in (2, 3, 4, 5):
        for pick in combinations(range(len(pool)), size):
            if any(not any((min(i, j), max(i, j)) in links for j in pick if j != i) for i in pick):
                continue
            part = [pool[i] for i in pick]
            total = sum(p["route_ft"] for p in part)
            if not max(target - 80, 0.84 * target) <= total <= max(1.38 * target, target + 220):
                continue
            seen, line = set(), []
            for p in part:
                for lat, lon in p["coords"]:
                    if (key := (round(lat, 8), round(lon, 8))) not in seen:
                        seen.add(key)
                        line.append((lat, lon))
            roles = Counter(p["route_role"] for p in part)
            ids = sorted(p["route_id"] for p in part)
            gates = [p["gate_ft"] for p in part if p["gate_ft"] is not None]
            out.append({
                "route_id": "synthetic_chain_" + "_".join(ids), "members": ids, "route_ft": total, "locality": sum(p["locality"] for p in part) / size,
                "box_share": sum(p["box_share"] for p in part) / size, "role": max((p["route_role"] for p in part), key=lambda r: roles[r]),
                "gate_ft": min(gates, default=None), "role_bonus": max(p["role_bonus"] for p in part), "priority": max(p["priority"] for p in part) + 0.85 * size, "line": line})
    return sorted(out, key=lambda c: (abs(round(c["route_ft"], 2) - target), -round(c["locality"], 4), -round(c["box_share"], 4), -round(c["priority"], 2), c["route_id"]))


def random_pool(rng, n, spread, target):
    pool = []
    for i in range(n):
        lat, lon = 30.1 + rng.uniform(0, spread), -96.4 + rng.uniform(0, spread)
        if pool and rng.random() < 0.5:  # begin where another one ends
            lat, lon = pool[rng.integers(len(pool))]["coords"][-1]
        steps = rng.normal(0, 0.0004, (rng.integers(1, 6), 2))
        line = [(float(lat), float(lon)), *((float(lat + y), float(lon + x)) for y, x in np.cumsum(steps, axis=0))]
        pool.append({"place": i + 1, "route_id": f"r{i:02d}", "route_role": str(rng.choice(["backbone", "other", "house_drop"])), "route_ft": float(np.round(rng.uniform(40, 400), 2)),
                     "coords": line, "locality": float(np.round(rng.uniform(), 4)), "box_share": float(np.round(rng.uniform(), 4)),
                     "gate_ft": None if rng.random() < 0.3 else float(np.round(rng.uniform(0, 400), 2)), "role_bonus": float(rng.choice([0.0, 85.0, 170.0])),
                     "priority": float(np.round(rng.uniform(0, 3), 2)), "target_ft": target})
    return pool


@pytest.fixture(scope="module")
def pools():
    rng = np.random.default_rng(21)
    return {("p1", "dense"): random_pool(rng, 25, 0.003, 900.0), ("p1", "sparse"): random_pool(rng, 25, 0.02, 500.0), ("p2", "short"): random_pool(rng, 12, 0.004, 150.0),
            ("p3", "alone"): random_pool(rng, 1, 0.01, 400.0), ("p4", "apart"): random_pool(rng, 6, 1.0, 400.0)}


def frames(spark, pools):
    rows = [(*log, *({**r, "route_id": f"{log[1]}_{r['route_id']}"}[c] for c in ("place", "route_id", "route_role", "route_ft", "coords", "locality", "box_share", "gate_ft", "role_bonus", "priority", "target_ft")))
            for log, pool in pools.items() for r in pool]
    pool = spark.createDataFrame(rows, POOL)
    return pool, chains.link_distances(pool.select("project_id", "route_id", "coords"))


def by_hand(log, pool):
    return chains_by_hand([{**r, "route_id": f"{log[1]}_{r['route_id']}"} for r in pool])


def test_all_chains_equal_all_combinations(spark, pools):
    """Every set of two to five, also those of two linked parts, in pools of 25."""
    pool, distances = frames(spark, pools)
    sets = chains.linked_sets(pool, chains.pool_links(pool, distances))
    found = {(r.project_id, r.source_file, tuple(r.members)) for r in sets.collect()}
    want = {(*log, tuple(int(i[-2:]) + 1 for i in c["members"])) for log, p in pools.items() for c in by_hand(log, p)}
    assert found == want and len({x[1] for x in want}) >= 3


@pytest.mark.parametrize("keep", [3, 10])
def test_best_chains_with_line_and_priority(spark, pools, keep):
    pool, distances = frames(spark, pools)
    found = {}
    for r in chains.best_chains(pool, distances, keep).collect():
        found.setdefault((r.project_id, r.source_file), {})[r.route_id] = r
    for log, p in pools.items():
        want = by_hand(log, p)[:keep]
        got = found.get(log, {})
        assert set(got) == {c["route_id"] for c in want}
        for c in want:
            r = got[c["route_id"]]
            assert (r.members, r.route_role, r.gate_ft, r.role_bonus) == (c["members"], c["role"], c["gate_ft"], c["role_bonus"])
            assert np.allclose([r.route_ft, r.locality, r.box_share, r.priority], [c["route_ft"], c["locality"], c["box_share"], c["priority"]], atol=[0.0051, 5.1e-5, 5.1e-5, 0.0051])
            assert [(q.lat, q.lon) for q in r.coords] == c["line"]


def test_pool_is_cut_only_when_asked(spark, pools):
    """The same pools through the corridor step: the most local routes by argument, all without it."""
    pool, distances = frames(spark, {k: v for k, v in pools.items() if k[1] == "sparse"})
    gated = pool.drop("place").withColumns({"max_ft": F.col("target_ft"), "span_ft": F.lit(1.0), "chain_seed": F.lit(True)})
    log, p = next((k, v) for k, v in pools.items() if k[1] == "sparse")
    ranked = sorted(p, key=lambda r: (-r["locality"], -r["box_share"], abs(r["route_ft"] - r["target_ft"]), r["gate_ft"] or 1e9, r["route_id"]))
    for size in (None, 18, 7):
        found = {r.route_id for r in corridors.synthetic_chains(gated, gated, distances, size, None).collect()}
        assert found == {c["route_id"] for c in by_hand(log, ranked[:size])}
