"""Field-construction tables derived from the given parquet tables.

Each view is one SQL text that both Spark and the check engine read; only row
generation differs per engine and is filled in by `_ROWS`.  Views keep every
source row, so work grows with the tables.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PROJECT = "concat('p', CAST(floor({key} / 10) AS BIGINT))"
_STATION = ("concat(CAST(({ft} - ({ft}) % 100) / 100 AS BIGINT), '+', "
            "lpad(CAST(({ft}) % 100 AS STRING), 2, '0'))")
_BORE_FT = ("(CAST(l_quantity AS BIGINT) * 25 + CASE WHEN l_suppkey % 3 = 0 AND l_quantity >= 20 "
            "THEN 400 ELSE 0 END)")

VIEWS = {
    # one design route per supplier, odd ones start where the even one before them ends
    "vertices": f"""
SELECT {_PROJECT.format(key='s_suppkey')} AS project_id, concat('route_', s_suppkey) AS route_id,
  CAST(k.idx AS INT) AS idx,
  CAST(30.16 AS DOUBLE) + ((s_suppkey - s_suppkey % 2) % 10) * CAST(0.004 AS DOUBLE)
    + CASE WHEN k.idx = 0 OR k.idx = 7 + s_suppkey % 25 THEN CAST(0 AS DOUBLE)
      ELSE ((k.idx * 7 + s_suppkey) % 5) * CAST(0.00004 AS DOUBLE) END AS lat,
  CAST(-96.40 AS DOUBLE) + CAST(floor(s_suppkey / 10) AS BIGINT) * CAST(0.02 AS DOUBLE)
    + CASE WHEN s_suppkey % 2 = 1 THEN (7 + (s_suppkey - 1) % 25) * CAST(0.00018 AS DOUBLE)
      ELSE CAST(0 AS DOUBLE) END + k.idx * CAST(0.00018 AS DOUBLE) AS lon
FROM {{supplier}} {{route_rows}}""",
    "route_meta": f"""
SELECT {_PROJECT.format(key='s_suppkey')} AS project_id, concat('route_', s_suppkey) AS route_id,
  s_suppkey AS doc_pos,
  concat(CASE s_suppkey % 5 WHEN 0 THEN 'Underground Cable' WHEN 1 THEN 'Backbone'
    WHEN 2 THEN 'Terminal Tail' WHEN 3 THEN 'Vacant Pipe' ELSE 'House Drop' END,
    CASE WHEN s_suppkey % 3 = 0 THEN ' Main' ELSE '' END) AS route_name,
  concat('Zone', s_suppkey % 2, ' Plant') AS source_folder
FROM {{supplier}}""",
    # one log per supplier over seven prints, 25-ft stations; every third log has a 425-ft jump
    "bore_rows": f"""
SELECT {_PROJECT.format(key='l_suppkey')} AS project_id,
  concat('zone', l_suppkey % 2, '_log_', l_suppkey) AS source_file,
  CASE WHEN l_linenumber = 6 THEN '5; 6' ELSE CAST(l_linenumber AS STRING) END AS print,
  {_STATION.format(ft=_BORE_FT)} AS station,
  round(3 + 20 * min(l_tax), 2) AS depth_ft, round(100 * max(l_discount), 2) AS boc_ft,
  CASE WHEN l_quantity < 36 THEN 'A' ELSE 'B' END AS crew, '' AS date,
  CASE WHEN min(l_linestatus) = 'F' THEN 'hard rock' ELSE '' END AS notes
FROM {{lineitem}}
GROUP BY l_suppkey, l_linenumber, l_quantity""",
    # which routes each print token shows; print 7 is on no sheet
    "sheet_index": f"""
SELECT {_PROJECT.format(key='s_suppkey')} AS project_id, CAST(t.idx % 6 + 1 AS STRING) AS token,
  CAST(t.idx % 6 + 1 AS INT) AS sheet,
  concat(CASE WHEN t.idx % 2 = 0 THEN 'E STONE' ELSE 'NIEBUHR' END, ' ST') AS street,
  concat('route_', s_suppkey) AS route_id
FROM {{supplier}} {{sheet_rows}}""",
    "messy_stations": """
SELECT l_orderkey, l_linenumber,
  replace(concat(CASE WHEN l_orderkey % 2 = 0 THEN ' ' ELSE '' END, CAST(l_partkey % 90 AS STRING),
    CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE '+' END, lpad(CAST(l_suppkey % 100 AS STRING), 2, '0')),
    CASE WHEN l_orderkey % 5 = 0 THEN '0' ELSE '1' END,
    CASE WHEN l_orderkey % 5 = 0 THEN 'O' ELSE 'l' END) AS raw_station
FROM {lineitem}""",
    # recognised table cells: one table per order, one row per line
    "cells": """
SELECT concat('scan_', l_suppkey % 50, '.pdf') AS source_file, l_orderkey AS table_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_linestatus) AS INT) AS row_index,
  CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN '' ELSE
    replace(concat(CAST(l_orderkey % 40 + floor(l_linenumber * 50 / 100) AS BIGINT), '+',
      lpad(CAST(l_linenumber * 50 % 100 + l_partkey % 3 AS STRING), 2, '0')), '0',
      CASE WHEN l_orderkey % 7 = 0 THEN 'O' ELSE '0' END) END AS station_raw,
  CASE WHEN l_partkey % 6 = 0 THEN '' WHEN l_partkey % 6 = 1
    THEN concat(l_linenumber + 1, CAST(l_quantity AS BIGINT) % 10)
    ELSE concat(l_linenumber, '.', CAST(l_quantity AS BIGINT) % 10, 'ft') END AS depth_raw,
  CASE WHEN l_partkey % 8 = 0 THEN '' ELSE
    replace(CAST(CAST(l_quantity AS BIGINT) % 23 AS STRING), '1', 'l') END AS boc_raw,
  CASE WHEN l_linestatus = 'F' THEN ' hard rock ' ELSE '' END AS notes
FROM {lineitem}""",
    # built stretches that cluster every 100 ft
    "built": f"""
SELECT {_PROJECT.format(key='l_suppkey')} AS project_id, concat('route_', l_suppkey) AS route_id,
  CAST((l_partkey * 37) % 7 * 100 + (l_partkey * 13) % 40 AS DOUBLE) AS start_ft,
  CAST((l_partkey * 37) % 7 * 100 + (l_partkey * 13) % 40 AS DOUBLE) + l_quantity / 2 AS end_ft,
  concat('log_', l_orderkey % 5) AS source_file, l_returnflag AS crew,
  CAST(l_orderkey % 3 AS STRING) AS date,
  l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_key
FROM {{lineitem}}""",
    "design_pages": """
SELECT concat('p', CAST(floor(doc_id / 100) AS BIGINT)) AS project_id, doc_id,
  concat('packet_', source) AS source_file, CAST(doc_id AS INT) AS page_number,
  concat('SHEET ', doc_id % 30 + 1, ' OF 30  E ', upper(lang), ' ST STA ', doc_id % 20,
    '+00 TO STA ', doc_id % 20 + 3, '+50 MATCHLINE STA ', doc_id % 20 + 3, '+50 - SEE SHEET ',
    doc_id % 30 + 2, CASE WHEN doc_id % 4 = 0 THEN ' STA 7+40 = 0+00' ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN ' PROP. SPLICE POINT 12' WHEN doc_id % 3 = 1 THEN ' VACANT HDPE'
      ELSE ' 288CT FIBER OPTIC CABLE' END, CASE WHEN doc_id % 5 = 0 THEN ' ROCK LEDGE' ELSE '' END) AS page_text
FROM {documents}""",
    # named design points at the start of each route
    "design_points": f"""
SELECT {_PROJECT.format(key='s_suppkey')} AS project_id, concat('route_', s_suppkey) AS point_id,
  concat(CASE s_suppkey % 4 WHEN 0 THEN 'SPLICE POINT ' WHEN 1 THEN 'VACANT HDPE ' WHEN 2 THEN 'CABLE ' ELSE 'POLE ' END,
    s_suppkey) AS name, 'Nodes' AS folder_path
FROM {{supplier}}""",
    "event_lines": """
SELECT doc_id AS line_number, concat(CASE doc_id % 6 WHEN 0 THEN 'Rock Adder - STA '
  WHEN 1 THEN 'Coupler at 50 ft from station ' WHEN 2 THEN 'Damage near '
  WHEN 3 THEN 'Restoration - add sod at ' WHEN 4 THEN 'Homeowner complaint at '
  ELSE 'No structures set to station ' END, doc_id % 40, '+',
  lpad(CAST(doc_id * 7 % 100 AS STRING), 2, '0')) AS line
FROM {documents}""",
    # a phone walk along the route of each user
    "gps_fixes": """
SELECT user_id AS session_id, event_id, ts, event_id % 12 AS delay_s,
  CAST(30.16 AS DOUBLE) + ((user_id - user_id % 2) % 10) * CAST(0.004 AS DOUBLE)
    + (event_id % 7) * CAST(0.00001 AS DOUBLE) AS lat,
  CAST(-96.40 AS DOUBLE) + CAST(floor(user_id % 100 / 10) AS BIGINT) * CAST(0.02 AS DOUBLE)
    + (event_id % 97) * CAST(0.00003 AS DOUBLE) AS lon,
  value AS accuracy_m, concat('route_', user_id % 100) AS route_id,
  concat('p', CAST(floor(user_id % 100 / 10) AS BIGINT)) AS project_id
FROM {events}""",
    "issue_reports": """
SELECT concat(event_type, '_', user_id % 7) AS fingerprint, ts, event_id, props AS details FROM {events}""",
    "text_rows": """
SELECT l_orderkey * 10 + l_linenumber AS line_number,
  CASE l_orderkey % 4 WHEN 0 THEN concat(lpad(CAST(l_partkey % 90 + 10 AS STRING), 2, '0'), '+',
      lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), ',', CAST(l_linenumber AS STRING), '.5,',
      CAST(CAST(l_quantity AS BIGINT) AS STRING))
    WHEN 1 THEN concat(lpad(CAST(l_partkey % 90 + 10 AS STRING), 2, '0'),
      lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), '|', CAST(l_linenumber AS STRING), '|',
      CASE WHEN l_partkey % 9 = 0 THEN 'none' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END)
    WHEN 2 THEN concat(lpad(CAST(l_partkey % 90 + 10 AS STRING), 2, '0'), '+',
      lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), ' ', CAST(l_linenumber AS STRING), ' ',
      CAST(CAST(l_quantity AS BIGINT) AS STRING))
    ELSE CASE WHEN l_partkey % 2 = 0 THEN 'STATION,DEPTH,BOC' ELSE concat('x', l_partkey, ',4') END
    END AS line
FROM {lineitem}""",
}

# Row generation, the one part the two engines spell differently.
_ROWS = {
    "spark": {
        "route_rows": "LATERAL VIEW explode(sequence(0, CAST(7 + s_suppkey % 25 AS INT))) k AS idx",
        "sheet_rows": "LATERAL VIEW explode(array(s_suppkey, s_suppkey + 1)) t AS idx",
    },
    "check": {
        "route_rows": ", unnest(range(0, CAST(8 + s_suppkey % 25 AS BIGINT))) AS k(idx)",
        "sheet_rows": ", unnest([s_suppkey, s_suppkey + 1]) AS t(idx)",
    },
}


#: Session setting: spread the rows of fact tables over so many partitions after the scan.  Meant
#: for files of one row group, which no split size can divide; unset, tables are read as they lie.
SPREAD = "spark.trenchline.spreadScans"
FACTS = ("lineitem", "orders", "events", "documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return df.repartition(int(spread)) if spread and name in FACTS else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    for key, rows in _ROWS["spark"].items():
        text = text.replace("{" + key + "}", rows)
    return spark.sql(text, **used)


@lru_cache(maxsize=None)
def cte(name: str) -> str:
    """The same derived table as `name AS (...)` for the check engine."""
    text = VIEWS[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    for key, rows in _ROWS["check"].items():
        text = text.replace("{" + key + "}", rows)
    return f"{name} AS ({text})"


def with_views(*names: str, then: str) -> str:
    """`WITH` the named views, then the rest (which may go on with `, x AS (...)`)."""
    return "WITH " + ",\n".join(cte(n) for n in names) + "\n" + then
