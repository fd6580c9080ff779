"""Design files in, map files out.

Reading: a map document is parsed one file per row, streaming, inside `mapInPandas`,
and only raw text leaves Python; coordinates, roles, lengths are Column work.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trenchline.functions import geo
from trenchline.functions import text as tx

PLACEMARKS = ("path string, feature_pos long, kind string, name string, description string, style string, "
              "folders array<string>, coord_text string, error string")


def _members(path: str, content: bytes, every: bool) -> list[bytes]:
    """Map documents of a file: the file itself, or the members of its archive."""
    low = path.lower()
    if low.endswith(".kml"):
        return [content]
    if not low.endswith(".kmz"):
        raise ValueError("a design must be a .kmz or .kml file")
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith(".kml")]
        if not names:
            raise ValueError("no map document in the archive")
        main = [n for n in names if n.lower().endswith("doc.kml")] or names
        return [archive.read(n) for n in (names if every else main[:1])]


def _geometries(mark: ElementTree.Element) -> Iterator[tuple[str, str]]:
    for node in mark.iterfind(".//{*}LineString/{*}coordinates"):
        yield "line", node.text or ""
    for poly in mark.iterfind(".//{*}Polygon"):
        ring = poly.find(".//{*}outerBoundaryIs/{*}LinearRing/{*}coordinates")
        if ring is not None:
            yield "polygon", ring.text or ""
    for node in mark.iterfind(".//{*}Point/{*}coordinates"):
        yield "point", node.text or ""
    for track in mark.iterfind(".//{*}Track"):
        yield "track", " ".join(",".join((c.text or "").split()) for c in track.iterfind("{*}coord"))


def _document_rows(path: str, document: bytes, first: int) -> Iterator[dict]:
    folders: list[ElementTree.Element] = []
    pos = first
    for event, node in ElementTree.iterparse(io.BytesIO(document), events=("start", "end")):
        tag = node.tag.rpartition("}")[2]
        if tag in ("Folder", "Document"):
            if event == "start":
                folders.append(node)
            else:
                folders.pop()
                node.clear()
        elif tag == "Placemark" and event == "end":
            names = [(f.findtext("{*}name") or "").strip() for f in folders]
            for kind, text in _geometries(node):
                yield {"path": path, "feature_pos": pos, "kind": kind, "name": (node.findtext("{*}name") or "").strip(),
                       "description": node.findtext("{*}description") or "", "style": node.findtext("{*}styleUrl") or "",
                       "folders": [n for n in names if n], "coord_text": text, "error": None}
                pos += 1
            node.clear()


def placemarks(files: DataFrame, every_member: bool = False) -> DataFrame:
    """One row per geometry of each file (path, content); a bad file is one row with its error."""
    columns = [c.strip().split(" ")[0] for c in PLACEMARKS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[dict] = []
                try:
                    for document in _members(path, content, every_member):
                        for row in _document_rows(path, document, len(rows)):
                            rows.append(row)
                except (ValueError, ElementTree.ParseError, zipfile.BadZipFile) as exc:
                    rows = [dict.fromkeys(columns) | {"path": path, "feature_pos": 0, "error": str(exc)}]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.select("path", "content").mapInPandas(parse, PLACEMARKS)


def read_designs(spark: SparkSession, path: str) -> DataFrame:
    """Landed .kml and .kmz files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.km[lz]").option("recursiveFileLookup", True).load(path)


def folder_path(folders: Column) -> Column:
    """Folder names below the document, joined; the document's own when it is alone."""
    return F.when(F.size(folders) > 1, F.array_join(F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(1))), " / ")).otherwise(
        F.coalesce(F.get(folders, F.lit(0)), F.lit("")))


def design_features(marks: DataFrame) -> DataFrame:
    """Lines (2 points up), polygons (3 up) and points with folder, role and length, numbered in order."""
    shaped = (
        marks.where(F.col("error").isNull() & (F.col("kind") != "track"))
        .withColumn("coords", tx.coordinate_text(F.col("coord_text")))
        .withColumn("coords", F.when(F.col("kind") == "point", F.slice("coords", 1, 1)).otherwise(geo.without_repeats(F.col("coords"))))
        .withColumn("least", F.when(F.col("kind") == "line", 2).when(F.col("kind") == "polygon", 3).otherwise(1))
        .where(F.size("coords") >= F.col("least"))
        .withColumn("name", F.when(F.col("name") == "", "Unnamed Feature").otherwise(F.col("name")))
        .withColumn("folder_path", folder_path(F.col("folders")))
    )
    number = F.row_number().over(Window.partitionBy("path").orderBy("feature_pos"))
    return shaped.withColumns({
        "feature_id": F.concat(F.col("kind"), F.lit("_"), number),
        "role": tx.route_role(F.col("folder_path"), F.col("name")),
        "length_ft": F.when(F.col("kind") == "line", F.round(geo.length_ft(F.col("coords")), 2)),
    }).select("path", "feature_id", "feature_pos", "kind", "name", "folder_path", "role", "description", "style", "coords", "length_ft")


def main_route(marks: DataFrame) -> DataFrame:
    """The line or track with most points in each file, the first of equals, and the candidate count."""
    lines = (marks.where(F.col("kind").isin("line", "track"))
             .withColumn("coords", tx.coordinate_text(F.col("coord_text"))).where(F.size("coords") >= 2))
    best = F.min_by(F.struct("coords"), F.struct((-F.size("coords")).alias("n"), (F.col("kind") == "track").alias("late"), F.col("feature_pos")))
    return lines.groupBy("path").agg(best.alias("r"), F.count("*").alias("n_candidates")).select("path", "r.coords", "n_candidates")


def replace_polygons(features: DataFrame, second: DataFrame) -> DataFrame:
    """Polygons of designs that a second extraction covers come from that extraction."""
    covered = second.where(F.col("kind") == "polygon").select("path").distinct()
    polygons = features.where(F.col("kind") == "polygon").join(covered, "path", "left_anti")
    return (features.where(F.col("kind") != "polygon").unionByName(polygons)
            .unionByName(second.where(F.col("kind") == "polygon")))


def feature_counts(features: DataFrame) -> DataFrame:
    """Features per folder, line role and point role, largest first by (n, name)."""
    return features.select("path", F.explode(F.array_compact(F.array(
        F.struct(F.lit("folder").alias("facet"), F.when(F.col("folder_path") == "", "root").otherwise(F.col("folder_path")).alias("label")),
        F.when(F.col("kind") == "line", F.struct(F.lit("line_role").alias("facet"), F.col("role").alias("label"))),
        F.when(F.col("kind") == "point", F.struct(F.lit("point_role").alias("facet"), F.col("role").alias("label"))),
    ))).alias("f")).groupBy("path", "f.facet", "f.label").agg(F.count("*").alias("n_features"))


def _lon_lat(coords: Column) -> Column:
    return F.transform(coords, lambda p: F.array(p["lon"], p["lat"]))


def line_geojson(coords: Column, properties: Column) -> Column:
    """A LineString feature as text."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("LineString").alias("type"), _lon_lat(coords).alias("coordinates")).alias("geometry")))


def point_geojson(lat: Column, lon: Column, properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))


def geojson_summary(vertices: DataFrame) -> DataFrame:
    """Route and point counts and the box of each project."""
    return vertices.groupBy("project_id").agg(
        F.countDistinct("route_id").alias("route_count"), F.count("*").alias("point_count"),
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def escape(value: Column) -> Column:
    """Text safe inside a map document."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def placemark_text(name: Column, style: str, kind: str, coords: Column, description: Column | None = None) -> Column:
    """One map-document placemark as text."""
    body = {
        "line": ("<LineString><tessellate>1</tessellate><coordinates>", "</coordinates></LineString>"),
        "polygon": ("<Polygon><outerBoundaryIs><LinearRing><coordinates>", "</coordinates></LinearRing></outerBoundaryIs></Polygon>"),
        "point": ("<Point><coordinates>", "</coordinates></Point>"),
    }[kind]
    about = F.lit("") if description is None else F.concat(F.lit("<description>"), escape(description), F.lit("</description>"))
    return F.concat(F.lit("<Placemark><name>"), escape(name), F.lit("</name>"), about, F.lit(f"<styleUrl>#{style}</styleUrl>{body[0]}"),
                    geo.coord_text(coords), F.lit(f"{body[1]}</Placemark>"))


# Export folders in document order.
EXPORT_FOLDERS = ("KMZ Shadow", "Design Lines", "House Drops", "As-Built", "Stations")


def export_lines(features: DataFrame, runs: DataFrame, stations: DataFrame) -> DataFrame:
    """Lines of an export document per project, ordered by (section, line_no).

    A project's document is never held in one row: it stays one row per placemark
    with its place, for an ordered text write.
    """
    house = F.col("role") == "house_drop"
    line = features.where((F.col("kind") == "line") & (F.size("coords") >= 2)).select(
        "project_id", F.when(house, 2).otherwise(1).alias("section"), F.col("feature_pos").alias("line_no"),
        F.when(house, placemark_text(F.col("name"), "houseDropStyle", "line", F.col("coords"))).otherwise(
            placemark_text(F.col("name"), "designLineStyle", "line", F.col("coords"))).alias("text"))
    shade = features.where((F.col("kind") == "polygon") & (F.size("coords") >= 3)).select(
        "project_id", F.lit(0).alias("section"), F.col("feature_pos").alias("line_no"),
        placemark_text(F.col("name"), "shadowPolyStyle", "polygon", geo.ring(F.col("coords"))).alias("text"))
    built = runs.where(F.size("coords") >= 2).select(
        "project_id", F.lit(3).alias("section"), F.col("run_no").alias("line_no"),
        placemark_text(F.col("name"), "asBuiltStyle", "line", F.col("coords"), F.col("description")).alias("text"))
    marks = stations.select(
        "project_id", F.lit(4).alias("section"), F.col("station_no").alias("line_no"),
        placemark_text(F.col("station"), "stationStyle", "point", F.array(geo.point(F.col("lat"), F.col("lon"))), F.col("description")).alias("text"))
    body = line.unionByName(shade).unionByName(built).unionByName(marks)
    present = body.select("project_id", "section").distinct()
    names = F.array(*[F.lit(n) for n in EXPORT_FOLDERS])
    opened = present.select("project_id", "section", F.lit(-1).cast("long").alias("line_no"),
                            F.concat(F.lit("<Folder><name>"), F.get(names, F.col("section")), F.lit("</name>")).alias("text"))
    closed = present.select("project_id", "section", F.lit(2**62).cast("long").alias("line_no"), F.lit("</Folder>").alias("text"))
    projects = present.select("project_id").distinct()
    head = projects.select("project_id", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("line_no"),
                           F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>').alias("text"))
    tail = projects.select("project_id", F.lit(9).alias("section"), F.lit(0).cast("long").alias("line_no"), F.lit("</Document></kml>").alias("text"))
    return body.unionByName(opened).unionByName(closed).unionByName(head).unionByName(tail)


def write_export(lines: DataFrame, path: str, files: int = 200) -> None:
    """Ordered text parts per project; parts concatenate in name order to the document."""
    order = ["project_id", "section", "line_no"]
    (lines.repartitionByRange(files, *order).sortWithinPartitions(*order)
     .select("project_id", "text").write.mode("overwrite").partitionBy("project_id").text(path))
