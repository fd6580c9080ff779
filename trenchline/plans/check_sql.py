"""SQL text shared by the checks: distances, route geometry."""

from __future__ import annotations

from trenchline.plans.inputs import cte


def hav(a: str, b: str, c: str, d: str, metres: bool = False) -> str:
    h = (f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
         f"* pow(sin(radians({d} - {b}) / 2), 2))")
    return f"(2 * 6371000.0 * {'1' if metres else '3.28084'} * atan2(sqrt({h}), sqrt(1 - {h})))"


def chained(name: str, source: str) -> str:
    step = hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")
    return f"""{name} AS (SELECT *, sum(step) OVER (PARTITION BY project_id, route_id ORDER BY idx) AS chain FROM
  (SELECT *, coalesce({step}, 0) AS step FROM {source} WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)))"""


def segments(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, sum(n_chunks) OVER (PARTITION BY project_id, route_id ORDER BY seg_idx) - n_chunks AS chunk_base FROM
  (SELECT *, greatest(1, CAST(ceil((end_ft - start_ft) / 60.0 - 1e-6) AS INT)) AS n_chunks FROM
  (SELECT project_id, route_id, row_number() OVER w - 2 AS seg_idx, lag(lat) OVER w AS a_lat, lag(lon) OVER w AS a_lon,
    lat AS b_lat, lon AS b_lon, lag(chain) OVER w AS start_ft, chain AS end_ft FROM {source}
    WINDOW w AS (PARTITION BY project_id, route_id ORDER BY idx)) WHERE seg_idx >= 0))"""


DENSE = """dense AS (SELECT project_id, route_id, k AS idx, a_lat + (b_lat - a_lat) * (k * 60.0 - start_ft) / (end_ft - start_ft) AS lat,
    a_lon + (b_lon - a_lon) * (k * 60.0 - start_ft) / (end_ft - start_ft) AS lon
  FROM (SELECT s.*, unnest(range(1, CAST(ceil((t - 1e-6) / 60.0) AS BIGINT))) AS k FROM seg s JOIN
    (SELECT project_id AS p, route_id AS r, max(end_ft) AS t FROM seg GROUP BY 1, 2) ON p = project_id AND r = route_id)
  WHERE k * 60.0 > start_ft AND k * 60.0 <= end_ft
  UNION ALL SELECT project_id, route_id, 0, lat, lon FROM ch WHERE idx = 0
  UNION ALL SELECT project_id, route_id, 1000000, arg_max(lat, idx), arg_max(lon, idx) FROM ch GROUP BY 1, 2)"""

ROLE = """CASE WHEN contains(h, 'backbone') THEN 'backbone' WHEN contains(h, 'terminal') AND contains(h, 'tail') THEN 'terminal_tail'
  WHEN contains(h, 'house') AND contains(h, 'drop') THEN 'house_drop' WHEN contains(h, 'vacant') THEN 'vacant_pipe'
  WHEN contains(h, 'underground') AND contains(h, 'cable') THEN 'underground_cable' ELSE 'other' END"""

CATALOG = f"""catalog_ AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY length_ft DESC, route_name, route_id) AS catalog_rank FROM
  (SELECT d.project_id, d.route_id, d.total_ft, round(d.total_ft, 2) AS length_ft, n AS point_count, route_name, source_folder, doc_pos,
   {ROLE} AS route_role FROM (SELECT project_id, route_id, max(chain) AS total_ft, count(*) AS n FROM dch GROUP BY 1, 2) d
   JOIN (SELECT *, lower(concat(source_folder, ' ', route_name)) AS h FROM route_meta) m ON m.project_id = d.project_id AND m.route_id = d.route_id))"""

# raw routes: ch (chained vertices), seg (segments)
RAW = [cte("vertices"), chained("ch", "vertices"), segments("seg", "ch")]
# densified catalog: dense, dch, dseg, catalog_
ROUTES = RAW + [DENSE, chained("dch", "dense"), segments("dseg", "dch"), cte("route_meta"), CATALOG]


def sql(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then
