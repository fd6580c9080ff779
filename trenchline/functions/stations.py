"""Station, depth and cover text to values, as Column expressions.

Each profile matches one way field sheets were captured (typed, recognised print,
handwriting, form template).  All of them stay in the JVM; none can fail a job:
bad text becomes null or an invalid flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike characters per capture profile.
HANDWRITING_STATION = ("Il|!/\\tTi" "OoDQUuC" "Ss$" "gq" "Gb" "zZa" "A" "xXhHkK*=#",
                       "111111111" "0000000" "555" "99" "66" "222" "4" "+++++++++")
SCAN_STATION = ("Il|!/\\tTi" "OoDQUuC" "Ss$" "gq" "zZ" "xXhHkK*=#",
                "111111111" "0000000" "555" "99" "22" "+++++++++")
HANDWRITING_NUMBER = ("Il|!/\\tTi" "OoDQUuC" "Ss$" "gq" "Gb" "zZa" "A" ",;:",
                      "111111111" "0000000" "555" "99" "66" "222" "4" "...")
SCAN_NUMBER = ("Il|!/\\tTi" "OoDQUuC" "Ss$" "gq" ",;:", "111111111" "0000000" "555" "99" "...")
TEMPLATE = ("OoQD" "Il|" "Ss" "Zz" "B" "," " —-_)([]{}/\\:;'\"",
            "0000" "111" "55" "22" "8" ".")
# Offsets that make a recognised station certain.
COMMON_OFFSETS = ("00", "25", "37", "44", "45", "48", "50", "63", "75")

_FINAL = r"^(?:0|[1-9]\d*)\+\d\d$"
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body) -> Column:
    """Bind a value once for a body that uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _swap(value: Column, table: tuple[str, str]) -> Column:
    return F.translate(value, table[0], table[1])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _whole(digits: Column) -> Column:
    """Digits without leading zeros, any length."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _two(digits: Column) -> Column:
    bare = _whole(digits)
    return F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)


def _before_plus(value: Column) -> Column:
    return F.substring_index(value, "+", 1)


def _after_plus(value: Column) -> Column:
    return F.regexp_replace(value, r"^[^+]*\+", "")


def _tail2(value: Column) -> Column:
    return F.right(value, F.lit(2))


def _drop_tail2(value: Column) -> Column:
    return F.left(value, F.length(value) - 2)


def _plus_join(left: Column, right: Column) -> Column:
    return F.concat(_whole(left), F.lit("+"), _two(right))


def _plus_or_split(value: Column) -> Column:
    """`A+B` from text that may lack the plus sign; null when it cannot be read."""
    return let(value, _read_plus)


def _read_plus(text: Column) -> Column:
    left, right, digits = _digits(_before_plus(text)), _digits(_after_plus(text)), _digits(text)
    return F.when(
        F.contains(text, F.lit("+")),
        F.when((left != "") & (right != ""), _plus_join(left, right)),
    ).otherwise(F.when(F.length(digits) >= 3, _plus_join(_drop_tail2(digits), _tail2(digits))))


def station_strict(value: Column) -> Column:
    """Typed station: digits each side of the plus sign, or at least three digits.

    Text already in final form, nearly all of it, takes the short way.
    """
    return F.when(value.rlike(_FINAL), value).otherwise(_plus_or_split(F.upper(F.trim(value))))


def station_scan(value: Column) -> Column:
    """Recognised print: O and Q read as 0, I and L as 1, other characters dropped."""
    return F.when(value.rlike(_FINAL), value).otherwise(_plus_or_split(
        F.regexp_replace(F.translate(F.upper(F.trim(value)), "OQIL", "0011"), "[^0-9+]", "")))


def station_handwritten(value: Column) -> Column:
    """Struct(text, valid, reason) for handwriting."""
    return let(F.regexp_replace(_swap(F.coalesce(value, F.lit("")), HANDWRITING_STATION), "[^0-9+]", ""),
               _read_handwritten)


def _read_handwritten(text: Column) -> Column:
    digits = _digits(text)
    text2 = F.when(
        ~F.contains(text, F.lit("+")) & (F.length(digits) >= 3),
        F.concat(_drop_tail2(digits), F.lit("+"), _tail2(digits)),
    ).otherwise(text)
    good = text2.rlike(r"^\d{1,3}\+\d{1,2}$")
    return F.struct(
        F.when(text == "", F.lit("")).when(good, _plus_join(_before_plus(text2), _after_plus(text2)))
        .otherwise(text2).alias("text"),
        ((text != "") & good).alias("valid"),
        F.when(text == "", "no station-like chars").when(good, "ok")
        .otherwise("station regex failed").alias("reason"),
    )


def station_two_digit(value: Column) -> Column:
    """Two-digit profile: four or five bare digits split after two, else unchanged."""
    return let(F.translate(F.trim(F.coalesce(value, F.lit(""))), "Oo ", "00"), _read_two_digit)


def _read_two_digit(text: Column) -> Column:
    digits = _digits(text)
    return F.when(F.contains(text, F.lit("+")), text).when(
        F.length(digits).isin(4, 5),
        F.concat(F.left(digits, F.lit(2)), F.lit("+"), F.substring(digits, 3, 3)),
    ).otherwise(text)


def station_template(value: Column) -> Column:
    """Form template: extra plus signs merge to the right, `d{1,3}+dd` or null."""
    return let(F.regexp_replace(_swap(F.trim(value), TEMPLATE), "[^0-9+]", ""), _read_template)


def _read_template(text: Column) -> Column:
    digits = _digits(text)
    pieces = F.filter(F.split(text, r"\+"), lambda p: p != "")
    merged = F.when(
        F.size(pieces) >= 2,
        F.concat(F.get(pieces, F.lit(0)), F.lit("+"),
                 F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), "")),
    ).otherwise(text)
    split2 = F.concat(_drop_tail2(digits), F.lit("+"), _tail2(digits))
    first = F.when(F.contains(text, F.lit("+")), merged).when(F.length(digits) >= 3, split2)
    second = F.when(F.length(digits) >= 3, F.concat(_whole(_drop_tail2(digits)), F.lit("+"), _tail2(digits)))
    shape = r"^\d{1,3}\+\d{2}$"
    return let(F.struct(first.alias("a"), second.alias("b")), lambda p: F.when(p["a"].isNull(), None).when(
        p["a"].rlike(shape), F.concat(_whole(_before_plus(p["a"])), F.lit("+"), _after_plus(p["a"]))
    ).when(p["b"].rlike(shape), p["b"]))


def station_candidates(value: Column) -> Column:
    """Ordered distinct readings of a noisy station cell."""
    return let(F.regexp_replace(_swap(F.coalesce(value, F.lit("")), SCAN_STATION), "[^0-9+]", ""), _readings)


def _readings(text: Column) -> Column:
    left, right, digits = _digits(_before_plus(text)), _digits(_after_plus(text)), _digits(text)
    usable = F.contains(text, F.lit("+")) & (left != "") & (right != "")

    def offset(piece: Column) -> Column:
        return F.when(F.length(piece) == 1, F.concat(piece, F.lit("0"))).otherwise(piece)

    options = [
        F.when(usable, F.concat(_whole(left), F.lit("+"), offset(F.left(right, F.lit(2))))),
        F.when(usable, F.concat(_whole(left), F.lit("+"), offset(_tail2(right)))),
    ]
    for take in (3, 4, 5):
        for piece in (F.left(digits, F.lit(take)), F.right(digits, F.lit(take))):
            options.append(F.when(
                F.length(digits) >= take,
                F.concat(_whole(_drop_tail2(piece)), F.lit("+"), _tail2(piece)),
            ))
    return F.array_distinct(F.filter(F.array(*options), lambda c: c.rlike(r"^\d{1,3}\+\d{2}$")))


def station_best(value: Column) -> Column:
    """Struct(station, valid, score): first reading, certain when its offset is common."""
    return let(F.get(station_candidates(value), F.lit(0)), _graded)


def _graded(best: Column) -> Column:
    return F.struct(
        F.coalesce(best, F.lit("")).alias("station"),
        best.isNotNull().alias("valid"),
        F.when(best.isNull(), 0.0).when(_after_plus(best).isin(*COMMON_OFFSETS), 1.0)
        .otherwise(0.75).alias("score"),
    )


def feet_from_station(station: Column) -> Column:
    """`A+B` to A*100+B feet; null when either side is not a number."""
    left = F.substring_index(station, "+", 1).try_cast("double")
    right = F.substr(station, F.locate("+", station) + 1).try_cast("double")
    return F.when(F.contains(station, F.lit("+")), left * 100 + right)


def feet_lenient(value: Column) -> Column:
    """Prefix `A+B`, else a plain number, else null."""
    text = F.trim(value)
    left = F.regexp_extract(text, r"^(\d+)\+(\d+)", 1)
    right = F.regexp_extract(text, r"^(\d+)\+(\d+)", 2)
    return F.when(left != "", left.try_cast("double") * 100 + right.try_cast("double")).otherwise(
        number(text))


def station_label(feet: Column, pad_left: bool = True) -> Column:
    """Feet to `A+BB`, the left side padded to two digits when asked."""
    return let(F.round(feet).cast("long"), lambda whole: _label(whole, pad_left))


def _label(whole: Column, pad_left: bool) -> Column:
    left = F.floor(whole / 100).cast("long").cast("string")
    if pad_left:
        left = F.when(F.length(left) < 2, F.lpad(left, 2, "0")).otherwise(left)
    return F.concat(left, F.lit("+"), F.lpad(F.pmod(whole, F.lit(100)).cast("string"), 2, "0"))


def number(value: Column) -> Column:
    """Number from text: as is, else with everything but digits, dot and minus dropped."""
    text = F.trim(value)
    stripped = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(text.rlike(_PLAIN_NUMBER), text.try_cast("double")).when(
        stripped.rlike(_PLAIN_NUMBER), stripped.try_cast("double"))


def first_number(value: Column, whole: bool = False) -> Column:
    """First number found in the text, as text; the cleaned text when there is none."""
    text = F.translate(F.trim(F.coalesce(value, F.lit(""))), "Oo" if whole else ",Oo", "00" if whole else ".00")
    found = F.regexp_extract(text, r"\d+" if whole else r"\d+(?:\.\d+)?", 0)
    return F.when(found != "", found).otherwise(text)


def _tenth(value: Column) -> Column:
    return F.format_string("%.1f", value)


def depth_handwritten(value: Column) -> Column:
    """Struct(text, valid, reason); a missing point goes after the first digit."""
    text = F.regexp_replace(_swap(F.coalesce(value, F.lit("")), HANDWRITING_NUMBER), "[^0-9.]", "")
    return let(F.struct(text.alias("t"), F.regexp_extract(text, r"\d+(?:\.\d)?", 0).alias("h")),
               lambda p: _read_depth(p["t"], p["h"]))


def _read_depth(text: Column, hit: Column) -> Column:
    shaped = F.when(
        ~F.contains(hit, F.lit(".")) & (F.length(hit) >= 2),
        F.concat(F.left(hit, F.lit(1)), F.lit("."), F.substring(hit, 2, 1)),
    ).otherwise(hit)
    amount = shaped.try_cast("double")
    inside = amount.between(0.5, 15.0)
    return F.struct(
        F.when(text == "", F.lit("")).when(hit == "", text).otherwise(_tenth(amount)).alias("text"),
        F.coalesce((hit != "") & inside, F.lit(False)).alias("valid"),
        F.when(text == "", "no numeric chars").when(hit == "", "depth parse failed")
        .when(inside, "ok").otherwise("depth out of range").alias("reason"),
    )


def boc_handwritten(value: Column) -> Column:
    """Struct(text, valid, reason); only the first digit counts."""
    digits = _digits(_swap(F.coalesce(value, F.lit("")), HANDWRITING_NUMBER))
    return let(digits, _read_boc)


def _read_boc(digits: Column) -> Column:
    return F.struct(
        F.left(digits, F.lit(1)).alias("text"),
        (digits != "").alias("valid"),
        F.when(digits == "", "no boc digits").otherwise("ok").alias("reason"),
    )


def _nearest(options: list[Column], target: float, low: float, high: float) -> Column:
    """Option with the least distance to target, out-of-range ones pushed back by ten."""
    ranked = [
        F.when(o.isNotNull(), F.struct(
            (F.abs(o - target) + F.when(o.between(low, high), 0.0).otherwise(10.0)).alias("penalty"),
            F.lit(i).alias("pos"), o.alias("value")))
        for i, o in enumerate(options)
    ]
    return F.array_min(F.filter(F.array(*ranked), lambda c: c.isNotNull()))["value"]


def depth_scan(value: Column) -> Column:
    """Struct(text, valid, score): reading nearest the usual depth of 4.3 ft."""
    return let(F.regexp_replace(_swap(F.coalesce(value, F.lit("")), SCAN_NUMBER), "[^0-9.]", ""),
               lambda t: let(F.struct(t.alias("t"), _nearest_depth(t).alias("b")), lambda p: _graded_depth(p["t"], p["b"])))


def _nearest_depth(text: Column) -> Column:
    digits = _digits(text)
    one_point = text.rlike(r"^\d\.\d$")

    def pointed(head: int) -> Column:
        return F.concat(F.left(digits, F.lit(head)), F.lit("."), F.substring(digits, head + 1, 1)).try_cast("double")

    return _nearest([
        F.when(one_point, text.try_cast("double")),
        F.when(F.length(digits) >= 2, pointed(1)),
        F.when(F.length(digits) >= 3, pointed(2)),
        F.when(F.length(digits) == 1, digits.try_cast("double")),
    ], 4.3, 0.5, 15.0)


def _graded_depth(text: Column, best: Column) -> Column:
    inside = best.between(0.5, 15.0)
    return F.struct(
        F.when(best.isNull(), text).otherwise(_tenth(best)).alias("text"),
        F.coalesce(inside, F.lit(False)).alias("valid"),
        F.when(text == "", 0.0).when(best.isNull(), 0.25).when(inside, 1.0).otherwise(0.3).alias("score"),
    )


def boc_scan(value: Column) -> Column:
    """Struct(text, valid, score): reading nearest the usual cover of 9."""
    return let(_digits(_swap(F.coalesce(value, F.lit("")), SCAN_NUMBER)),
               lambda d: let(F.struct(d.alias("d"), _nearest_boc(d).alias("b")), lambda p: _graded_boc(p["d"], p["b"])))


def _nearest_boc(digits: Column) -> Column:
    singles = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.try_cast("double"))
    pair = F.when(F.length(digits) >= 2, F.array(F.left(digits, F.lit(2)).try_cast("double"))).otherwise(
        F.array().cast("array<double>"))
    options = F.concat(singles, pair)
    ranked = F.transform(options, lambda v, i: F.struct(
        (F.abs(v - 9) + F.when(v.between(0, 20), 0.0).otherwise(10.0)).alias("penalty"),
        i.alias("pos"), v.alias("value")))
    return F.array_min(ranked)["value"]


def _graded_boc(digits: Column, best: Column) -> Column:
    return F.struct(
        F.when(digits == "", F.lit("")).otherwise(best.cast("long").cast("string")).alias("text"),
        F.coalesce((digits != "") & best.between(0, 20), F.lit(False)).alias("valid"),
        F.when(digits == "", 0.0).when(best.between(0, 20), 1.0).otherwise(0.3).alias("score"),
    )


def depth_template(value: Column) -> Column:
    """Form template depth: 0 < depth <= 40, two decimals."""
    return let(F.regexp_replace(_swap(F.trim(value), TEMPLATE), "[^0-9.]", ""), _read_template_depth)


def _read_template_depth(text: Column) -> Column:
    one = F.concat(F.regexp_replace(text, r"\..*$", ""), F.lit("."),
                   F.regexp_replace(F.regexp_replace(text, r"^[^.]*\.", ""), r"\.", ""))
    many = F.length(text) - F.length(F.regexp_replace(text, r"\.", "")) > 1
    joined = F.when(many, one).otherwise(text)
    return let(F.when(F.startswith(joined, F.lit(".")), F.concat(F.lit("0"), joined)).otherwise(joined), _template_depth_value)


def _template_depth_value(led: Column) -> Column:
    digits = _digits(led)
    shaped = F.when(led.rlike(r"^\d{1,2}(?:\.\d{1,2})?$"), led).when(
        F.length(digits) >= 2,
        F.concat(F.left(digits, F.lit(1)), F.lit("."), F.right(digits, F.length(digits) - 1)))
    amount = shaped.try_cast("double")
    return F.when((amount > 0) & (amount <= 40), F.round(amount, 2))


def boc_template(value: Column) -> Column:
    """Form template cover: one or two digits, at most 50."""
    digits = F.regexp_replace(_swap(F.trim(value), TEMPLATE), "[^0-9]", "")
    amount = F.when(digits.rlike(r"^\d{1,2}$"), digits.try_cast("int"))
    return F.when(amount <= 50, amount)


def row_confidence(conf: list[Column], station: Column, depth: Column, boc: Column) -> Column:
    """Mean recognition confidence, cut when a field stayed unread."""
    mean = (conf[0] + conf[1] + conf[2]) / 3.0
    cut = (F.when(station.isNull(), 0.35).otherwise(1.0)
           * F.when(depth.isNull(), 0.65).otherwise(1.0)
           * F.when(boc.isNull(), 0.65).otherwise(1.0))
    return F.round(F.least(F.greatest(mean * cut, F.lit(0.0)), F.lit(1.0)), 3)


def first_reading(candidates: Column, normalise) -> Column:
    """First candidate text that normalises; candidates is array<struct<text,confidence>>."""
    read = F.transform(candidates, lambda c: F.struct(
        normalise(c["text"]).alias("value"), c["text"].alias("raw"), c["confidence"].alias("confidence")))
    hit = F.get(F.filter(read, lambda r: r["value"].isNotNull()), F.lit(0))
    return F.coalesce(hit, F.get(read, F.lit(0)))


def looks_like_station(value: Column) -> Column:
    return value.rlike(r"^\d{2}\+\d{2,3}$")


def looks_like_depth(value: Column) -> Column:
    return value.rlike(r"^\d+(?:\.\d+)?$")


def looks_like_boc(value: Column) -> Column:
    return value.rlike(r"^\d+$")
