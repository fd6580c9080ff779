"""Queries over sources, sinks and row stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.functions import text as tx
from trenchline.plans.inputs import table, view, with_views
from trenchline.plans.queries_text import feet_sql, first_number_sql, number_sql, strict_sql, two_digit_sql
from trenchline.plans.registry import query
from trenchline.session import new_path
from trenchline.sources.keyed_store import KeyedStore
from trenchline.sources import bore_logs as src
from trenchline.sources import exports, stores


@query("bore_log_scan", with_views("bore_rows", then=f"""
SELECT project_id, source_file, {strict_sql('station')} AS station, {feet_sql(strict_sql('station'))} AS station_ft,
  depth_ft, boc_ft, crew, date, print, notes FROM bore_rows WHERE {strict_sql('station')} IS NOT NULL"""))
def bore_log_scan(spark, sf_dir):
    raw = view(spark, sf_dir, "bore_rows").withColumnsRenamed({"depth_ft": "Depth ", "boc_ft": "BOC"})
    return src.scan_bore_table(raw).drop("station_raw")


@query("tolerant_table_scan", with_views("messy_stations", then=f"""
, a AS (SELECT m.l_orderkey, m.l_linenumber, raw_station, l_tax, l_discount FROM messy_stations m
  JOIN lineitem l ON m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber)
SELECT concat('book_', l_orderkey) AS source_file,
  {strict_sql("translate(upper(trim(raw_station)), 'OQIL', '0011')")} AS station,
  {feet_sql(strict_sql("translate(upper(trim(raw_station)), 'OQIL', '0011')"))} AS station_ft,
  3 + 20 * l_tax AS depth_ft, 100 * l_discount AS boc_ft, '' AS notes, '' AS date, 'nine' AS crew,
  CAST(l_linenumber AS VARCHAR) AS print FROM a"""))
def tolerant_table_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    joined = view(spark, sf_dir, "messy_stations").join(lines, ["l_orderkey", "l_linenumber"])
    sheet = joined.select(
        F.concat(F.lit("book_"), "l_orderkey").alias("source_file"), F.col("raw_station").alias(" Stationing"),
        (3 + 20 * F.col("l_tax")).alias("Depth (Feet)"), (100 * F.col("l_discount")).alias("Cover-Ft"),
        F.lit("nine").alias("Drill Crew"), F.col("l_linenumber").alias("Page"))
    cover = sheet.select("source_file", F.lit("x").alias("remarks"))
    return src.scan_tolerant_table(src.best_sheet({"Cover": cover, "Log": sheet}))


_SHEETS = """SELECT l_orderkey AS sheet_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS row_index,
  CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN 'Start Station:' ELSE concat('n', l_linenumber) END AS c0,
  CASE WHEN l_orderkey % 3 = 1 THEN concat(CAST(l_partkey % 90 AS STRING), '+', lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'))
    WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN '' END AS c1,
  CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN concat(CAST(l_partkey % 90 AS STRING), '+76') ELSE 'x' END AS c2,
  CASE WHEN l_orderkey % 3 = 0 THEN 'End  Station' ELSE concat(CAST(l_partkey % 80 AS STRING), '+', CAST(l_linenumber AS STRING)) END AS c3,
  CASE WHEN l_partkey % 5 = 0 THEN 'n/a' ELSE concat(CAST(l_partkey % 90 AS STRING), '+9') END AS c4 FROM {lineitem}"""
_HEADERS = """SELECT o_orderkey AS sheet_id, CAST(0 AS INT) AS col_index, 'Row' AS header FROM {orders}
  UNION ALL SELECT o_orderkey, CAST(4 AS INT), CASE WHEN o_orderkey % 2 = 0 THEN 'To Station' ELSE 'Misc' END FROM {orders}"""
_COLUMNS = ["c0", "c1", "c2", "c3", "c4"]
_CELL = r"'\d{1,4}\+\d{1,2}'"


@query("station_range_layouts", f"""
WITH rows_ AS ({_SHEETS.replace('{lineitem}', 'lineitem')}), heads AS ({_HEADERS.replace('{orders}', 'orders')}),
form AS (SELECT sheet_id, arg_min(c2, row_index) AS start_station, arg_min(c4, row_index) AS end_station FROM rows_
  WHERE regexp_replace(lower(c0), '[^a-z0-9]', '', 'g') = 'startstation' AND regexp_full_match(c4, {_CELL}) GROUP BY 1),
long AS (SELECT sheet_id, row_index, 0 AS col, c0 AS v FROM rows_ UNION ALL SELECT sheet_id, row_index, 1, c1 FROM rows_
  UNION ALL SELECT sheet_id, row_index, 2, c2 FROM rows_ UNION ALL SELECT sheet_id, row_index, 3, c3 FROM rows_
  UNION ALL SELECT sheet_id, row_index, 4, c4 FROM rows_),
nth AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, col ORDER BY row_index) AS n FROM long WHERE v IS NOT NULL),
hits AS (SELECT sheet_id, col FROM nth GROUP BY 1, 2 HAVING count(*) FILTER (regexp_full_match(trim(v), {_CELL})) >= 2),
likes AS (SELECT sheet_id, list(col ORDER BY col) AS cs FROM hits GROUP BY 1),
named AS (SELECT sheet_id, min(col_index) FILTER (lower(header) = 'to station') AS e FROM heads GROUP BY 1),
cols AS (SELECT coalesce(n.sheet_id, l.sheet_id) AS sheet_id, CASE WHEN len(cs) >= 2 THEN cs[1] END AS s,
  coalesce(e, CASE WHEN len(cs) >= 2 THEN cs[2] END) AS e FROM named n FULL JOIN likes l ON n.sheet_id = l.sheet_id),
tab AS (SELECT r.sheet_id, r.row_index, trim([c0, c1, c2, c3, c4][s + 1]) AS start_station, trim([c0, c1, c2, c3, c4][e + 1]) AS end_station
  FROM rows_ r JOIN cols c ON c.sheet_id = r.sheet_id WHERE s IS NOT NULL AND e IS NOT NULL),
both_ AS (SELECT sheet_id, CAST(NULL AS INT) AS row_index, start_station, end_station, 'form' AS source_mode FROM form
  UNION ALL SELECT sheet_id, row_index, start_station, end_station, 'tabular' FROM tab
  WHERE regexp_full_match(start_station, {_CELL}) AND regexp_full_match(end_station, {_CELL})
  AND sheet_id NOT IN (SELECT sheet_id FROM form))
SELECT *, {feet_sql('start_station')} AS start_ft, {feet_sql('end_station')} AS end_ft FROM both_""")
def station_range_layouts(spark, sf_dir):
    rows = spark.sql(_SHEETS, lineitem=table(spark, sf_dir, "lineitem"))
    heads = spark.sql(_HEADERS, orders=table(spark, sf_dir, "orders"))
    return src.station_ranges(rows, heads, _COLUMNS)


_BULK_CHECK = with_views("text_rows", then=f"""
, a AS (SELECT *, CASE WHEN contains(line, '|') THEN list_transform(string_split(line, '|'), lambda x: trim(x))
   WHEN contains(line, ',') THEN list_transform(string_split(line, ','), lambda x: trim(x))
   ELSE [regexp_extract(line, '\\d{{2}}\\s*\\+?\\s*\\d{{2,3}}'), regexp_extract_all(line, '\\d+(?:\\.\\d+)?')[-2],
     regexp_extract_all(line, '\\d+(?:\\.\\d+)?')[-1]] END AS p FROM text_rows),
b AS (SELECT *, {two_digit_sql('p[1]')} AS station, {first_number_sql('p[2]', False)} AS depth,
  {first_number_sql('p[3]', True)} AS boc FROM a)
SELECT line_number, line, station, depth, boc, CASE WHEN contains(line, 'STATION') THEN 'Header row skipped'
  WHEN len(p) < 3 THEN concat('Could not split into 3 values: ', line)
  WHEN NOT regexp_full_match(station, '\\d{{2}}\\+\\d{{2,3}}') THEN concat('Invalid station: ', p[1])
  WHEN NOT regexp_full_match(depth, '\\d+(?:\\.\\d+)?') THEN concat('Invalid depth: ', p[2])
  WHEN NOT regexp_full_match(boc, '\\d+') THEN concat('Invalid BOC: ', p[3]) END AS reject_reason FROM b""")


@query("bulk_lines", _BULK_CHECK)
def bulk_lines(spark, sf_dir):
    return src.parse_bulk_lines(view(spark, sf_dir, "text_rows"))


_CSV_BASE = with_views("text_rows", then=f"""
, a AS (SELECT *, list_transform(string_split(line, ','), lambda x: trim(x)) AS p FROM text_rows
  WHERE NOT (contains(upper(line), 'STATION') AND contains(upper(line), 'DEPTH'))),
b AS (SELECT *, {two_digit_sql('p[1]')} AS station, {first_number_sql('p[2]', False)} AS depth, {first_number_sql('p[3]', True)} AS boc FROM a),
c AS (SELECT line_number, station, depth, boc, CASE WHEN len(p) < 3 THEN 'Expected at least 3 columns: station, depth, boc'
  WHEN NOT regexp_full_match(station, '\\d{{2}}\\+\\d{{2,3}}') THEN concat('Invalid station: ', p[1])
  WHEN NOT regexp_full_match(depth, '\\d+(?:\\.\\d+)?') THEN concat('Invalid depth: ', p[2])
  WHEN NOT regexp_full_match(boc, '\\d+') THEN concat('Invalid BOC: ', p[3]) END AS reject_reason FROM b)
""")


@query("csv_lines", _CSV_BASE + "SELECT * FROM c")
def csv_lines(spark, sf_dir):
    return src.parse_csv_lines(view(spark, sf_dir, "text_rows")).drop("line")


@query("saved_rows_append", _CSV_BASE + """SELECT station, depth, boc, min(line_number) AS line_number FROM c
  WHERE reject_reason IS NULL GROUP BY 1, 2, 3""")
def saved_rows_append(spark, sf_dir):
    good = src.parse_csv_lines(view(spark, sf_dir, "text_rows")).where("reject_reason IS NULL").drop("line", "reject_reason")
    return stores.append_rows(good, good, replace=False)


@query("saved_rows_csv", _CSV_BASE + """SELECT station, depth, boc, count(*) AS n FROM c WHERE reject_reason IS NULL GROUP BY 1, 2, 3""")
def saved_rows_csv(spark, sf_dir):
    """Saved rows as written to CSV and read again."""
    good = src.parse_csv_lines(view(spark, sf_dir, "text_rows")).where("reject_reason IS NULL")
    exports.write_saved_rows(good, path := new_path(spark, "saved_rows"))
    return exports.read_csv(spark, path).groupBy(*exports.SAVED_COLUMNS).agg(F.count("*").alias("n"))


_REVISED = with_views("bore_rows", then="""
SELECT project_id, source_file, print, station, CASE WHEN source_file LIKE 'zone0%' THEN 'revised' ELSE notes END AS notes
FROM bore_rows""")


@query("stored_by_source", _REVISED)
def stored_by_source(spark, sf_dir):
    """The same through a stored table: all files, then a second upload of some of them."""
    rows = view(spark, sf_dir, "bore_rows").select("project_id", "source_file", "print", "station", "notes")
    store = KeyedStore(spark, new_path(spark, "rows_by_source"), rows.schema, buckets=8)
    store.replace(rows)
    store.replace(rows.where(F.startswith("source_file", F.lit("zone0"))).withColumn("notes", F.lit("revised")))
    return store.read()


@query("replace_by_source", _REVISED)
def replace_by_source(spark, sf_dir):
    rows = view(spark, sf_dir, "bore_rows").select("project_id", "source_file", "print", "station", "notes")
    revised = rows.where(F.startswith("source_file", F.lit("zone0"))).withColumn("notes", F.lit("revised"))
    return stores.replace_by_source(rows, revised)


@query("field_points", with_views("gps_fixes", then="""
SELECT CASE WHEN event_id % 4 = 0 THEN concat('P', event_id) ELSE concat('g', event_id) END AS id, event_id AS sequence,
  round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(event_id % 360 AS DOUBLE) AS heading_deg, CASE WHEN event_id % 6 = 0 THEN NULL ELSE accuracy_m END AS depth_ft,
  event_id % 9 AS rod, 'bore_csv' AS source FROM gps_fixes WHERE event_id % 5 <> 0"""))
def field_points(spark, sf_dir):
    fixes = view(spark, sf_dir, "gps_fixes")
    eid = F.col("event_id")
    text = fixes.select(
        eid.alias("line_number"), F.when(eid % 4 == 0, "").otherwise(F.concat(F.lit("g"), eid)).alias("id"),
        F.lit("").alias("sequence"), F.when(eid % 2 == 0, F.format_string("%.6f", "lat")).otherwise("").alias("lat"),
        F.when(eid % 5 == 0, "bad").otherwise(F.format_string("%.6f", "lat")).alias("latitude"),
        F.when(eid % 5 == 0, "").otherwise(F.format_string("%.6f", "lon")).alias("lon"),
        (eid % 360).cast("string").alias("heading_deg"),
        F.when(eid % 6 == 0, "deep").otherwise(F.col("accuracy_m").cast("string")).alias("depth"),
        F.concat((eid % 9).cast("string"), F.lit(".7")).alias("rod"))
    return src.load_field_points(text)


@query("event_lines", with_views("event_lines", then=r"""
SELECT line_number, line AS description,
  CASE line_number % 6 WHEN 0 THEN 'rock' WHEN 1 THEN 'coupler' WHEN 2 THEN 'damage' WHEN 3 THEN 'restoration'
    WHEN 4 THEN 'complaint' ELSE 'note' END AS event_type,
  CAST(regexp_extract(line, '(\d+)\+(\d+)', 1) AS BIGINT) * 100 + CAST(regexp_extract(line, '(\d+)\+(\d+)', 2) AS BIGINT) AS station_ft,
  CASE WHEN line_number % 6 = 1 THEN 50 END AS offset_ft,
  CASE WHEN line_number % 6 = 1 THEN CAST(regexp_extract(line, '(\d+)\+(\d+)', 1) AS BIGINT) * 100
    + CAST(regexp_extract(line, '(\d+)\+(\d+)', 2) AS BIGINT) END AS offset_from_ft,
  CASE line_number % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'critical' WHEN 3 THEN 'medium'
    WHEN 4 THEN 'high' ELSE 'low' END AS severity, line_number % 6 IN (0, 1, 2) AS billable FROM event_lines"""))
def event_lines(spark, sf_dir):
    return src.parse_event_lines(view(spark, sf_dir, "event_lines"))


@query("page_text_scan", with_views("design_pages", then=r"""
SELECT doc_id, source_file, page_number, count(*) OVER (PARTITION BY source_file) AS page_total,
  trim(regexp_replace(page_text, '\s+', ' ', 'g')) AS compact_text FROM design_pages"""))
def page_text_scan(spark, sf_dir):
    return src.scan_page_text(view(spark, sf_dir, "design_pages")).select(
        "doc_id", "source_file", "page_number", "page_total", "compact_text")


_TABLE_PAGES = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS n,
  concat(lpad(CAST(l_partkey % 90 + 10 AS STRING), 2, '0'), lpad(CAST(l_suppkey % 100 AS STRING), 2, '0'), ' ',
    CAST(l_linenumber AS STRING), '.5  ', CASE WHEN l_partkey % 9 = 0 THEN 'x' ELSE '8' END) AS t FROM {lineitem}"""


@query("page_table_rows", f"""
WITH l AS ({_TABLE_PAGES.replace('{lineitem}', 'lineitem')}),
p AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY n, t) AS k FROM l),
b AS (SELECT doc_id, k AS line_number, {two_digit_sql("split_part(t, ' ', 1)")} AS station, split_part(t, ' ', 1) AS depth, CAST(n AS VARCHAR) AS d2 FROM p)
SELECT doc_id, station, depth, concat(d2, '') AS boc, min(line_number) AS line_number FROM b GROUP BY 1, 2, 3, 4""")
def page_table_rows(spark, sf_dir):
    lines = spark.sql(_TABLE_PAGES, lineitem=table(spark, sf_dir, "lineitem"))
    pages = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("ls")).select(
        "doc_id", F.concat(F.lit("STATION DEPTH BOC\n"), F.array_join(F.transform("ls", lambda x: x["t"]), "\n")).alias("page_text"))
    return src.page_table_rows(pages)


@query("file_categories", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'bore_log' WHEN 1 THEN 'gis_route' WHEN 2 THEN 'gis_route' WHEN 3 THEN 'design_pdf'
  WHEN 4 THEN 'bore_log' ELSE 'unknown' END AS category FROM pages""")
def file_categories(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    ext = F.get(F.array(*[F.lit(e) for e in (".xlsx", ".KMZ", ".kml", ".pdf", ".v2.csv", ".txt")]),
                (F.col("page_id") % 6).cast("int"))
    return pages.select("page_id", tx.file_category(F.concat(F.lit("f"), ext)).alias("category"))


@query("issue_log", with_views("issue_reports", then="""
SELECT fingerprint, count(*) AS n, max(ts) AS last_seen, arg_max(details, (ts, event_id)) AS details, max(event_id) AS last_id
FROM issue_reports GROUP BY 1"""))
def issue_log(spark, sf_dir):
    return stores.upsert_issues(view(spark, sf_dir, "issue_reports"))


@query("newest_issues", with_views("issue_reports", then="""
SELECT fingerprint, ts, event_id, details FROM issue_reports ORDER BY ts DESC, event_id DESC LIMIT 200"""))
def newest_issues(spark, sf_dir):
    return stores.newest_issues(view(spark, sf_dir, "issue_reports"))


@query("photo_index", with_views("gps_fixes", then="""
, pts AS (SELECT DISTINCT route_id, concat('log_', session_id % 10) AS source_file, CAST(event_id % 90 AS VARCHAR) || '+00' AS station,
  CAST(event_id % 90 * 100 AS DOUBLE) AS ft FROM gps_fixes),
ph AS (SELECT event_id, route_id, concat('log_', session_id % 10) AS source_file, CAST(event_id % 90 AS VARCHAR) || '+00' AS station,
  CAST(event_id % 90 * 100 AS DOUBLE) AS ft, session_id FROM gps_fixes),
h AS (SELECT *, sha256(concat_ws('|', route_id, source_file, station, printf('%.3f', ft), '30.16000000', '-96.40000000')) AS station_hash FROM ph),
ok AS (SELECT session_id, event_id // 8 AS up FROM h GROUP BY 1, 2 HAVING count(*) <= 10)
SELECT station_hash, route_id, source_file, station, concat('img', event_id, '.jpg') AS filename, CAST(event_id AS VARCHAR) AS uploaded_at,
  sha256(concat_ws('|', station_hash, concat('img', event_id, '.jpg'), CAST(event_id AS VARCHAR)))[1:24] AS photo_id
FROM h WHERE event_id % 3 <> 0 AND (session_id, event_id // 8) IN (SELECT (session_id, up) FROM ok)"""))
def photo_index(spark, sf_dir):
    uploads, points = _photo_uploads(spark, sf_dir)
    return stores.photo_index(stores.accept_photos(uploads), points)


@query("photo_uploads", with_views("gps_fixes", then="""
, u AS (SELECT event_id, concat('img', event_id, '.jpg') AS filename, count(*) OVER (PARTITION BY session_id, event_id // 8) AS n FROM gps_fixes)
SELECT event_id, CASE WHEN n > 10 THEN 'Upload up to 10 files at a time.' WHEN event_id % 3 = 0 THEN concat(filename, ' is not an image upload.') END AS reject_reason FROM u"""))
def photo_uploads(spark, sf_dir):
    uploads, _ = _photo_uploads(spark, sf_dir)
    return stores.judge_photos(uploads).select(F.col("uploaded_at").cast("long").alias("event_id"), "reject_reason")


def _photo_uploads(spark, sf_dir):
    """Uploaded files, and the located stations they belong to."""
    ft = (F.col("event_id") % 90 * 100).cast("double")
    located = view(spark, sf_dir, "gps_fixes").select(
        "event_id", "session_id", "route_id", F.concat(F.lit("log_"), F.col("session_id") % 10).alias("source_file"),
        F.concat((F.col("event_id") % 90).cast("string"), F.lit("+00")).alias("station"), ft.alias("ft"))
    hashed = located.withColumn("station_hash", stores.station_identity(
        F.col("route_id"), F.col("source_file"), F.col("station"), F.col("ft"), F.lit(30.16), F.lit(-96.4)))
    uploads = hashed.select(
        "station_hash", F.concat_ws("-", F.col("session_id").cast("string"), F.floor(F.col("event_id") / 8).cast("string")).alias("upload_id"),
        F.concat(F.lit("img"), "event_id", F.lit(".jpg")).alias("filename"), F.col("event_id").cast("string").alias("uploaded_at"),
        F.when(F.col("event_id") % 3 == 0, "text/plain").otherwise("image/jpeg").alias("content_type"))
    return uploads, hashed.select("station_hash", "route_id", "source_file", "station").distinct()


@query("intake_audit", with_views("bore_rows", then="""
SELECT source_file, date, crew, project_id AS job_name, print, 2 * count(*) AS n_uploads FROM bore_rows GROUP BY ALL"""))
def intake_audit(spark, sf_dir):
    """The audit table after two appends of all uploads."""
    uploads = view(spark, sf_dir, "bore_rows").withColumnRenamed("project_id", "job_name")
    path = new_path(spark, "audit")
    for _ in range(2):
        stores.audit_append(uploads, path)
    return spark.read.parquet(path).groupBy("source_file", "date", "crew", "job_name", "print").agg(F.count("*").alias("n_uploads"))
