"""Text to tokens, classes and extracted facts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sheet-text patterns (case-insensitive).
STREET = (r"(?i)\b(?:[NSEW]\s+)?[A-Z0-9][A-Z0-9'&.-]*(?:\s+[A-Z0-9][A-Z0-9'&.-]*)*\s+"
          r"(?:ST|STREET|RD|ROAD|DR|DRIVE|LN|LANE|AVE|AVENUE|BLVD|BOULEVARD|CT|COURT|CIR|CIRCLE|"
          r"TRL|TRAIL|PKWY|PARKWAY|WAY|PL|PLACE|HWY|HIGHWAY)\b")
ADDRESS = r"(?i)\b\d{2,5}\s+[A-Z0-9][A-Z0-9'&.-]*(?:\s+[A-Z0-9][A-Z0-9'&.-]*)*\b"
SHEET = r"(?i)\b(\d{1,2})\s+OF\s+(\d{1,2})\b"
DRAWING = r"(?i)\b([A-Z0-9_-]+_P_\s*\d+\.DWG)\b"
STATION_RANGE = r"(?i)STA\s*([0-9OQIL]+\+[0-9OQIL]{2})\s*(?:TO|-)\s*STA?\s*([0-9OQIL]+\+[0-9OQIL]{2})"
MATCHLINE = r"(?i)MATCHLINE\s+STA\s*([0-9OQIL+\/\s]+?)\s*-\s*SEE\s+SHEET\s*([A-Z0-9-]+)"
EQUATION = r"(?i)STA\s*([0-9OQIL]+\+[0-9OQIL]{2})\s*=\s*([0-9OQIL]+\+[0-9OQIL]{2})"
STATION_TOKEN = r"(?i)[0-9OQIL]+\+[0-9OQIL]{2}"
SPLICE = r"(?i)(?:PROP\.\s*)?SPLICE\s+POINT\s+([A-Z0-9-]+)"
HANDHOLE = (r"(?i)(?:PLACE\s+)?(?:\d+\"X\d+\"X\d+\"\s+)?"
            r"([A-Z0-9\"-]+\s*(?:HH|HANDHOLE|FLOWER POT|INSTALLER HH|PORT HH))")
CONTEXT = (r"(?i)\b(?:AP-\d+|PROP\.\s*SPLICE\s+POINT\s+\d+|TERMINAL\s+\d+\s+PORT\s+HH|FLOWER\s+POT|"
           r"INSTALLER\s+HH|VACANT\s+HDPE|PORT\s+TERMINAL\s+TAIL|\d+CT\s+FIBER\s+OPTIC\s+CABLE|DIR\.\s+BORE)\b")
COORDINATE_PAIR = r"(-?\d{1,3}\.\d{4,})[^\d-]+(-?\d{1,3}\.\d{4,})"

# Column-name aliases of tolerant table scans, best first.
TABLE_ALIASES = {
    "station": ("station", "sta", "stationing", "station_no", "station_number"),
    "depth_ft": ("depth_ft", "depth", "depth_feet"),
    "boc_ft": ("boc_ft", "boc", "bore_of_cover", "cover_ft"),
    "notes": ("notes", "note", "comments", "comment", "description", "reason"),
    "date": ("date", "work_date", "drill_date"),
    "crew": ("crew", "drill_crew"),
    "print": ("print", "sheet", "page", "print_page"),
}
# Headers that make one sheet of a workbook the better one.
SHEET_SCORE_HEADERS = ("station", "depth_ft", "depth", "boc_ft", "boc", "notes", "note", "comments",
                       "date", "crew", "print", "page", "print_page", "sheet", "sheet_page")


def has(text: Column, *words: str) -> Column:
    """True when any of the words occurs in the text."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def ordered_distinct(items: Column) -> Column:
    """Trimmed, non-blank items, first spelling of each kept, in order."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(trimmed, lambda x: F.lower(x))
    return F.filter(trimmed, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def print_tokens(value: Column) -> Column:
    """Sheet tokens of a print cell, split at commas and semicolons."""
    parts = F.split(F.translate(F.coalesce(value, F.lit("")), ";", ","), ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def header_key(value: Column, joiner: str = "_") -> Column:
    """Lower-case header; runs of other characters become the joiner."""
    low = F.lower(F.trim(value))
    if not joiner:
        return F.regexp_replace(low, "[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")


def route_role(folder: Column, name: Column) -> Column:
    hint = F.lower(F.trim(F.concat_ws(" ", folder, name)))
    return (
        F.when(has(hint, "backbone"), "backbone")
        .when(has(hint, "terminal") & has(hint, "tail"), "terminal_tail")
        .when(has(hint, "house") & has(hint, "drop"), "house_drop")
        .when(has(hint, "vacant"), "vacant_pipe")
        .when(has(hint, "underground") & has(hint, "cable"), "underground_cable")
        .otherwise("other")
    )


def design_type(name: Column, description: Column, style: Column, length_ft: Column) -> Column:
    """Struct(type, role, eligible) of a network segment, by words then by length."""
    text = F.lower(F.concat_ws(" ", name, description, style))

    def kind(type_: str, role: str = "network", eligible: bool = True) -> Column:
        return F.struct(F.lit(type_).alias("type"), F.lit(role).alias("role"), F.lit(eligible).alias("eligible"))

    return (
        F.when(has(text, "splice"), kind("splice", "structure", False))
        .when(has(text, "slack/pull", "handhole", "hh", "cabinet", "flower pot", "terminal port"),
              kind("structure", "structure", False))
        .when(has(text, "vacant", "empty conduit"), kind("vacant_conduit"))
        .when(has(text, "tail"), kind("terminal_tail"))
        .when(has(text, "backbone", "trunk", "mainline"), kind("backbone"))
        .when(has(text, "lateral", "drop"), kind("lateral"))
        .when(has(text, "rod", "rope"), kind("rod_rope", eligible=False))
        .when(has(text, "strand"), kind("strand", eligible=False))
        .when(has(text, "conduit", "bore"), kind("new_conduit"))
        .when(has(text, "fiber", "cable"), kind("fiber_path"))
        .when(length_ft >= 350, kind("backbone"))
        .when(length_ft >= 120, kind("lateral"))
        .otherwise(kind("terminal_tail"))
    )


def expected_roles(context: Column, span_ft: Column) -> Column:
    """Roles a run of rows points to: named ones first, then the usual ones for its span."""
    text = F.lower(context)

    def said(role: str, test: Column) -> Column:
        return F.when(test, F.lit(role))

    named = F.array_compact(F.array(
        said("vacant_pipe", has(text, "vacant")),
        said("house_drop", has(text, "drop") & has(text, "house")),
        said("terminal_tail", has(text, "tail")),
        said("backbone", has(text, "backbone")),
        said("underground_cable", has(text, "cable", "fiber")),
    ))

    def roles(*items: str) -> Column:
        return F.array(*[F.lit(i) for i in items])

    usual = (F.when(span_ft <= 160, roles("house_drop", "vacant_pipe", "terminal_tail"))
             .when(span_ft <= 1200, roles("terminal_tail", "underground_cable", "vacant_pipe"))
             .otherwise(roles("underground_cable", "backbone", "terminal_tail")))
    return F.array_distinct(F.concat(named, usual))


def role_bonus(role: Column, expected: Column) -> Column:
    place = F.array_position(expected, role)
    return F.when(place == 1, 0.18).when(place == 2, 0.10).when(place > 2, 0.04).otherwise(0.0)


def corridor_roles(context: Column) -> Column:
    """Preferred route roles for a corridor, from its labels."""
    text = F.lower(context)
    tail, vacant = has(text, "terminal"), has(text, "vacant")
    cable = has(text, "288ct", "48ct", "12ct", "fiber optic cable", "splice point", "dir. bore")
    roles = F.array_compact(F.array(
        F.when(tail, F.lit("terminal_tail")),
        F.when(vacant, F.lit("vacant_pipe")),
        F.when(cable, F.lit("underground_cable")),
        F.when(cable & ~tail & ~vacant, F.lit("backbone")),
    ))
    return F.when(F.size(roles) > 0, roles).otherwise(
        F.array(F.lit("terminal_tail"), F.lit("vacant_pipe"), F.lit("underground_cable")))


def tokens(value: Column, min_length: int = 3, keep_numbers: bool = False) -> Column:
    """Lower-case words of at least min_length, numbers dropped unless asked for."""
    words = F.split(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "), " ")
    keep = F.filter(words, lambda w: F.length(w) >= min_length)
    return keep if keep_numbers else F.filter(keep, lambda w: ~w.rlike("^[0-9]+$"))


def name_words(source_file: Column) -> Column:
    """Words of a file name, four letters up."""
    return F.filter(F.split(F.translate(F.lower(source_file), "-_", "  "), r"\s+"),
                    lambda w: F.length(w) >= 4)


def name_hint(words: Column, route_text: Column) -> Column:
    """Share of file-name words found in the route text, at most .12."""
    low = F.lower(route_text)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.round(F.least(hits * 0.03, F.lit(0.12)), 3)


def event_class(value: Column) -> Column:
    """Struct(type, severity, billable) of a field note; first hit wins."""
    text = F.lower(value)

    def kind(type_: str, severity: str, billable: bool) -> Column:
        return F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"),
                        F.lit(billable).alias("billable"))

    return (
        F.when(has(text, "rock"), kind("rock", "high", True))
        .when(has(text, "damage"), kind("damage", "critical", True))
        .when(has(text, "coupler"), kind("coupler", "medium", True))
        .when(has(text, "sod", "restoration"), kind("restoration", "medium", False))
        .when(has(text, "homeowner"), kind("complaint", "high", False))
        .otherwise(kind("note", "low", False))
    )


def _station_at(value: Column, pattern: str, first: int) -> Column:
    left, right = F.regexp_extract(value, pattern, first), F.regexp_extract(value, pattern, first + 1)
    return F.when(left != "", left.try_cast("long") * 100 + right.try_cast("long"))


def event_station(value: Column) -> Column:
    return _station_at(value, r"(?:STA\s*)?(\d+)\+(\d+)", 1)


def event_offset(value: Column) -> Column:
    """Struct(distance_ft, from_station) of `N ft from station A+B`."""
    pattern = r"(\d+)\s*[’']?\s*(?:ft|feet)?\s*from station\s*(\d+)\+(\d+)"
    low = F.lower(value)
    distance = F.regexp_extract(low, pattern, 1)
    return F.struct(
        F.when(distance != "", distance.try_cast("long")).alias("distance_ft"),
        _station_at(low, pattern, 2).alias("from_station"),
    )


def coordinate_pairs(value: Column, lat: tuple[float, float] = (20, 40), lon: tuple[float, float] = (-110, -80)) -> Column:
    """Ordered distinct (lat, lon) pairs in the given area, whichever order they were written in."""
    first = F.regexp_extract_all(value, F.lit(COORDINATE_PAIR), 1)
    second = F.regexp_extract_all(value, F.lit(COORDINATE_PAIR), 2)

    def point(lat: Column, lon: Column) -> Column:
        return F.struct(F.round(lat.cast("double"), 7).alias("lat"), F.round(lon.cast("double"), 7).alias("lon"))

    both = F.flatten(F.zip_with(first, second, lambda a, b: F.array(point(a, b), point(b, a))))
    return F.array_distinct(F.filter(
        both, lambda p: p["lat"].between(*lat) & p["lon"].between(*lon)))


def coordinate_text(value: Column) -> Column:
    """Whitespace-separated `lon,lat[,alt]` tuples to an array of (lat, lon); bad tuples dropped."""
    tuples = F.filter(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "), lambda t: F.contains(t, F.lit(",")))
    points = F.transform(tuples, lambda t: F.struct(
        F.get(F.split(t, ","), F.lit(1)).try_cast("double").alias("lat"),
        F.get(F.split(t, ","), F.lit(0)).try_cast("double").alias("lon")))
    return F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


# Display names that differ from the flag itself.
FLAG_NAMES = {"DEPTH_JUMP": "Depth Change", "BOC_JUMP": "Rod Change", "OUT_OF_SEQUENCE": "Out of Sequence"}


def flag_label(flag: Column) -> Column:
    """`STATION_GAP` to `Station Gap`."""
    label = F.initcap(F.lower(F.translate(flag, "_", " ")))
    for key, name in FLAG_NAMES.items():
        label = F.when(flag == key, name).otherwise(label)
    return label


def qa_colour(flags: Column, offset_ft: Column, offset_limit_ft: float) -> Column:
    """Marker colour of a point: worst flag first, then distance off the route."""
    jumps = F.array(*[F.lit(f) for f in ("SHALLOW_DEPTH", "DEPTH_JUMP", "STATION_GAP", "BOC_JUMP")])
    return (F.when(F.array_contains(flags, "HIGH_RISK"), "red")
            .when(F.arrays_overlap(flags, jumps), "orange")
            .when(offset_ft > offset_limit_ft, "yellow")
            .otherwise("green"))


def file_category(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return (F.when(ext.isin("csv", "xlsx", "xls", "json"), "bore_log")
            .when(ext.isin("kmz", "kml"), "gis_route")
            .when(ext == "pdf", "design_pdf").otherwise("unknown"))
