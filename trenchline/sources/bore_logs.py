"""Field-log sources: table scans, form and tabular sheets, pasted lines, point and event files.

Every reader returns accepted rows, or accepted rows and rejects with a reason.
Text values come in as strings; nothing here can fail a job on a bad cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trenchline.functions import stations as st
from trenchline.functions import text as tx

BORE_SCHEMA = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("station", T.StringType()),
    T.StructField("depth", T.StringType()),
    T.StructField("boc", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("crew", T.StringType()),
    T.StructField("print", T.StringType()),
    T.StructField("notes", T.StringType()),
])


def _blank_to_empty(value: Column) -> Column:
    """Trimmed text; null, NaN and the text `nan` count as blank."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | F.lower(text).isin("nan", "none"), "").otherwise(text)


def _integral(value: Column) -> Column:
    """`1420.0` read from a numeric cell is station text `1420`."""
    return F.regexp_replace(value.cast("string"), r"^(\d+)\.0+$", "$1")


def _amount(df: DataFrame, name: str) -> Column:
    """Number of a column: as it is when numeric already, else read from its text."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return st.number(F.col(name))


def clean_bore_rows(raw: DataFrame) -> DataFrame:
    """Typed log rows with a reject reason (null for accepted rows)."""
    text = F.col("station") if isinstance(raw.schema["station"].dataType, T.StringType) else _integral(F.col("station"))
    read = raw.withColumn("_read", st.station_strict(text))
    return read.select(
        "project_id", "source_file",
        F.col("station").cast("string").alias("station_raw"),
        F.col("_read").alias("station"),
        st.feet_from_station(F.col("_read")).alias("station_ft"),
        _amount(raw, "depth_ft").alias("depth_ft"),
        _amount(raw, "boc_ft").alias("boc_ft"),
        _blank_to_empty(F.col("date")).alias("date"),
        _blank_to_empty(F.col("crew")).alias("crew"),
        _blank_to_empty(_integral(F.col("print"))).alias("print"),
        _blank_to_empty(F.col("notes")).alias("notes"),
        F.when(F.col("_read").isNull(), "unreadable station").alias("reject_reason"),
    )


def scan_bore_table(df: DataFrame) -> DataFrame:
    """Strict table scan: trimmed lower-case headers; station, depth and boc must exist."""
    named = df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])
    missing = [c for c in ("station", "depth", "boc") if c not in named.columns]
    if missing:
        raise ValueError(f"bore log lacks columns: {', '.join(missing)}")
    for optional in ("project_id", "source_file", "date", "crew", "print", "notes"):
        if optional not in named.columns:
            named = named.withColumn(optional, F.lit(""))
    named = named.withColumnsRenamed({"depth": "depth_ft", "boc": "boc_ft"})
    return clean_bore_rows(named).where(F.col("reject_reason").isNull()).drop("reject_reason")


def read_bore_csv(spark, path: str) -> DataFrame:
    """Landed CSV logs; the file name becomes source_file."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return scan_bore_table(df.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))


def _plain_key(header: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in header.strip().lower())
    return "_".join(kept.split())


def best_sheet(sheets: dict[str, DataFrame]) -> DataFrame:
    """The sheet with most known headers; the first of equals."""
    def score(df: DataFrame) -> int:
        return sum(_plain_key(c) in tx.SHEET_SCORE_HEADERS for c in df.columns)
    return max(sheets.values(), key=score)


def scan_tolerant_table(df: DataFrame) -> DataFrame:
    """Alias-tolerant table scan: first known header per field, rows without a station dropped."""
    keyed = {}
    for column in df.columns:
        keyed[_plain_key(column)] = column

    def pick(field: str) -> Column | None:
        hit = next((keyed[a] for a in tx.TABLE_ALIASES[field] if a in keyed), None)
        return None if hit is None else F.col(f"`{hit}`").cast("string")

    station = pick("station")
    if station is None:
        raise ValueError("a bore log needs a station column")
    df = df.withColumn("_read", st.station_scan(station))
    fields = [F.col("_read").alias("station"), st.feet_from_station(F.col("_read")).alias("station_ft")]
    for name in ("depth_ft", "boc_ft"):
        col = pick(name)
        fields.append((st.number(col) if col is not None else F.lit(None).cast("double")).alias(name))
    for name in ("notes", "date", "crew", "print"):
        col = pick(name)
        fields.append((_blank_to_empty(col) if col is not None else F.lit("")).alias(name))
    keep = [c for c in ("project_id", "source_file") if c in df.columns]
    return df.select(*keep, *fields).where(F.col("station").isNotNull())


def drop_empty(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with no value outside `keep` dropped; columns with no value at all dropped."""
    data = [c for c in df.columns if c not in keep]
    rows = df.dropna("all", subset=data)
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in data]).first()
    return rows.select(*keep, *[F.col(f"`{c}`") for c in data if counts[c] > 0])


_STATION_CELL = r"^\d{1,4}\+\d{1,2}$"
_START_LABELS = ("startstation", "beginstation", "fromstation")
_END_LABELS = ("endstation", "tostation")


def _sheet_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's trimmed cells and its own form pair (null on most rows).

    A start label, then the first station to its right,
    and an end label further right in the same row.  A sheet row is a short array,
    so this needs no self-join; of several pairs in a row the leftmost counts.
    """
    def value_after(pos: Column) -> Column:
        ahead = F.slice(F.col("cells"), pos + 2, F.size("cells"))
        return F.get(F.filter(ahead, lambda c: c.rlike(_STATION_CELL)), F.lit(0))

    def label_positions(names: tuple[str, ...]) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("keys") - 1),
                        lambda i: F.get(F.col("keys"), i).isin(*names))

    def pair_at(pos: Column) -> Column:
        end = F.get(F.filter(label_positions(_END_LABELS), lambda i: i > pos), F.lit(0))
        return F.struct(F.col("row_index").alias("row_index"), pos.alias("start_pos"),
                        value_after(pos).alias("start_station"), value_after(end).alias("end_station"))

    read = rows.select("sheet_id", "row_index", F.array(*[F.trim(F.col(c)) for c in columns]).alias("cells"),
                       F.array(*[tx.header_key(F.col(c), "") for c in columns]).alias("keys"))
    pairs = F.filter(F.transform(label_positions(_START_LABELS), pair_at),
                     lambda p: p["start_station"].isNotNull() & p["end_station"].isNotNull())
    labelled = F.arrays_overlap("keys", F.array(*[F.lit(x) for x in _START_LABELS]))
    return read.select("sheet_id", "row_index", "cells", F.when(labelled, F.get(pairs, F.lit(0))).alias("pair"))


def form_station_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """First start/end pair of each form sheet."""
    pairs = _sheet_rows(rows, columns).where(F.col("pair").isNotNull())
    return (pairs.groupBy("sheet_id").agg(F.min("pair").alias("p"))
            .select("sheet_id", "p.start_station", "p.end_station",
                    st.feet_from_station(F.col("p.start_station")).alias("start_ft"),
                    st.feet_from_station(F.col("p.end_station")).alias("end_ft"),
                    F.lit("form").alias("source_mode")))


def named_columns(headers: DataFrame) -> DataFrame:
    """Start and end column of each sheet by its header words; sheets without such words have no row."""
    starts, ends = "|".join(_START_LABELS), "|".join(_END_LABELS)
    keyed = headers.select("sheet_id", "col_index", tx.header_key(F.col("header"), "").alias("key"))
    return (keyed.where(F.col("key").rlike(f"{starts}|{ends}")).groupBy("sheet_id")
            .agg(F.min(F.when(F.col("key").rlike(starts), F.col("col_index"))).alias("named_start"),
                 F.min(F.when(F.col("key").rlike(ends), F.col("col_index"))).alias("named_end")))


def station_ranges(rows: DataFrame, headers: DataFrame, columns: list[str]) -> DataFrame:
    """Form pair when a sheet has one, else its rows whose start and end cells both hold stations.

    Start and end column: by header words, else the first two columns with at least two
    station-like values.  The rows are read once: what holds for a sheet comes from windows
    over its rows, so neither forms nor columns are joined back.
    """
    sheet = Window.partitionBy("sheet_id")
    hits = [F.count_if(F.get("cells", F.lit(i)).rlike(_STATION_CELL)).over(sheet) for i in range(len(columns))]
    seen = _sheet_rows(rows, columns).withColumn("nth", F.row_number().over(sheet.orderBy(F.asc_nulls_last("pair"))))
    seen = seen.select("*", F.count("pair").over(sheet).alias("forms"), F.array(*hits).alias("hits"))
    like = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: F.get(F.col("hits"), i) >= 2)
    seen = (seen.where((F.col("nth") == 1) | (F.col("forms") == 0)).select("*", like.alias("like"))
            .join(named_columns(headers), "sheet_id", "left"))
    both, form = F.size("like") >= 2, F.col("forms") > 0
    start_col = F.coalesce("named_start", F.when(both, F.get("like", F.lit(0))))
    end_col = F.coalesce("named_end", F.when(both, F.get("like", F.lit(1))))
    # a row without a sheet can be a form, but has no columns of its own
    placed = F.col("sheet_id").isNotNull() & start_col.isNotNull() & end_col.isNotNull()
    found = seen.select(
        "sheet_id", F.when(~form, F.col("row_index")).alias("row_index"),
        F.when(form, F.col("pair.start_station")).when(placed, F.get("cells", start_col)).alias("start_station"),
        F.when(form, F.col("pair.end_station")).when(placed, F.get("cells", end_col)).alias("end_station"),
        F.when(form, "form").otherwise("tabular").alias("source_mode"))
    return found.where(F.col("start_station").rlike(_STATION_CELL) & F.col("end_station").rlike(_STATION_CELL)).select(
        "sheet_id", "start_station", "end_station",
        st.feet_from_station(F.col("start_station")).alias("start_ft"),
        st.feet_from_station(F.col("end_station")).alias("end_ft"),
        "source_mode", "row_index")


def parse_bulk_lines(lines: DataFrame) -> DataFrame:
    """Pasted lines (tab, bar, comma or free text) to station, depth, boc, with a reason when refused."""
    line = F.trim(F.coalesce(F.col("line"), F.lit("")))

    def parts_of(pattern: str) -> Column:
        return F.filter(F.transform(F.split(line, pattern), lambda p: F.trim(p)), lambda p: p != "")

    marked = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("|")) | F.contains(line, F.lit(","))
    numbers = F.regexp_extract_all(line, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    loose = F.regexp_extract(line, r"\d{2}\s*\+?\s*\d{2,3}", 0)
    free = ~marked & (loose != "") & (F.size(numbers) >= 3)
    parts = (F.when(F.contains(line, F.lit("\t")), parts_of("\t"))
             .when(F.contains(line, F.lit("|")), parts_of(r"\|"))
             .when(F.contains(line, F.lit(",")), parts_of(","))
             .when(free, F.array(loose, F.get(numbers, F.size(numbers) - 2), F.get(numbers, F.size(numbers) - 1)))
             .otherwise(parts_of(r"\s+")))
    upper = F.upper(line)
    shaped = lines.withColumns({"_line": line, "_free": free, "_parts": parts,
                                "_header": tx.has(upper, "STATION") & tx.has(upper, "DEPTH")})
    return _checked(shaped, F.col("_parts"), short=F.concat(F.lit("Could not split into 3 values: "), F.col("line")),
                    first=F.when(F.col("_line") == "", "Empty line").when(F.col("_header"), "Header row skipped"),
                    free=F.col("_free"))


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """CSV text lines by the same rules; blank and header lines are skipped, not refused."""
    cells = F.transform(F.split(F.coalesce(F.col("line"), F.lit("")), ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"),
                        lambda c: F.trim(F.regexp_replace(c, "^\"|\"$", "")))
    upper = F.upper(F.array_join(F.col("_parts"), " "))
    shaped = lines.withColumn("_parts", cells).where(
        (F.array_join(F.col("_parts"), "") != "") & ~(tx.has(upper, "STATION") & tx.has(upper, "DEPTH")))
    return _checked(shaped, F.col("_parts"), short=F.lit("Expected at least 3 columns: station, depth, boc"),
                    first=F.lit(None).cast("string"), free=F.lit(False))


def _checked(df: DataFrame, parts: Column, short: Column, first: Column, free: Column) -> DataFrame:
    raw = [F.get(parts, F.lit(i)) for i in range(3)]
    station, depth, boc = st.station_two_digit(raw[0]), st.first_number(raw[1]), st.first_number(raw[2], whole=True)
    good = [st.looks_like_station(station), st.looks_like_depth(depth), st.looks_like_boc(boc)]
    reason = (
        F.when(first.isNotNull(), first)
        .when(F.size(parts) < 3, short)
        .when(free & ~(good[0] & good[1] & good[2]), F.concat(F.lit("Could not normalize line: "), F.col("line")))
        .when(~good[0], F.concat(F.lit("Invalid station: "), raw[0]))
        .when(~good[1], F.concat(F.lit("Invalid depth: "), raw[1]))
        .when(~good[2], F.concat(F.lit("Invalid BOC: "), raw[2]))
    )
    helpers = [c for c in df.columns if c.startswith("_")]
    return df.withColumns({"station": station, "depth": depth, "boc": boc, "reject_reason": reason}).drop(*helpers)


def load_field_points(rows: DataFrame) -> DataFrame:
    """Point rows with latitude/longitude aliases; rows without a usable position dropped."""
    def first_filled(*names: str) -> Column:
        return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in rows.columns])

    def as_int(col: Column) -> Column:
        return F.floor(F.abs(col.try_cast("double"))).cast("long") * F.signum(col.try_cast("double")).cast("long")

    position = F.col("line_number").cast("string")
    return rows.select(
        F.coalesce(first_filled("id"), F.concat(F.lit("P"), position)).alias("id"),
        as_int(F.coalesce(first_filled("sequence"), position)).alias("sequence"),
        first_filled("lat", "latitude").try_cast("double").alias("lat"),
        first_filled("lon", "longitude").try_cast("double").alias("lon"),
        first_filled("heading", "heading_deg").try_cast("double").alias("heading_deg"),
        first_filled("depth", "depth_ft").try_cast("double").alias("depth_ft"),
        as_int(first_filled("rod", "rod_number")).alias("rod"),
        F.lit("bore_csv").alias("source"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """Field notes to typed events; blank lines dropped."""
    line = F.trim(F.col("line"))
    kind, offset = tx.event_class(line), tx.event_offset(line)
    return lines.where(line != "").select(
        "line_number", kind["type"].alias("event_type"), line.alias("description"),
        tx.event_station(line).alias("station_ft"),
        offset["distance_ft"].alias("offset_ft"), offset["from_station"].alias("offset_from_ft"),
        kind["severity"].alias("severity"), kind["billable"].alias("billable"))


def scan_page_text(pages: DataFrame) -> DataFrame:
    """Design-sheet text with runs of whitespace collapsed, and the page count of its file."""
    total = pages.groupBy("source_file").agg(F.count("*").alias("page_total"))
    return pages.join(total, "source_file").withColumn(
        "compact_text", F.trim(F.regexp_replace("page_text", r"\s+", " ")))


def page_table_rows(pages: DataFrame) -> DataFrame:
    """Rows of recognised page text: first word is the station, the first two numbers of the
    line are depth and cover; exact repeats within a page removed."""
    line = F.trim(F.col("raw_line"))
    upper = F.upper(line)
    numbers = F.regexp_extract_all(line, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    rows = (
        pages.select("doc_id", F.posexplode(F.split("page_text", "\n")).alias("line_number", "raw_line"))
        .where((line != "") & ~tx.has(upper, "STATION", "DEPTH", "BOC"))
        .where(line.rlike(r"\s") & (F.size(numbers) >= 2))
        .select("doc_id", "line_number",
                st.station_two_digit(F.get(F.split(line, r"\s+"), F.lit(0))).alias("station"),
                st.first_number(F.get(numbers, F.lit(0))).alias("depth"),
                st.first_number(F.get(numbers, F.lit(1)), whole=True).alias("boc"))
        .where(st.looks_like_station(F.col("station")) & st.looks_like_depth(F.col("depth"))
               & st.looks_like_boc(F.col("boc")))
    )
    return rows.groupBy("doc_id", "station", "depth", "boc").agg(F.min("line_number").alias("line_number"))
