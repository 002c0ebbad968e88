"""Scalar expressions over measured regions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where whole is not positive."""
    return F.when(whole > 0, F.try_divide(part.cast("double"), whole.cast("double"))).otherwise(F.lit(0.0))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter <= 0, F.lit(0.0)).otherwise(F.lit(4.0) * F.pi() * F.try_divide(area, perimeter * perimeter))


def equivalent_diameter(area_px: Column, um2_per_px: Column) -> Column:
    """Diameter in micrometres of the disc with the area of so many pixels."""
    return F.sqrt(F.lit(4.0) * area_px / F.pi()) * F.sqrt(um2_per_px)


def eccentricity(var_x: Column, var_y: Column, cov: Column) -> Column:
    """Of the ellipse with these second moments: 0 for a circle, towards 1 for a line."""
    half = (var_x + var_y) / 2
    spread = F.sqrt(((var_x - var_y) / 2) * ((var_x - var_y) / 2) + cov * cov)
    large, small = half + spread, half - spread
    return F.when(large <= 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(small, large))))


def um2_per_px(mpp_x: Column, mpp_y: Column, downsample: Column) -> Column:
    return mpp_x * downsample * mpp_y * downsample


def resolved_level(level: Column, levels: Column) -> Column:
    """The level, or the last one there is; a negative level fails the query."""
    return F.when(F.assert_true(level >= 0, F.lit("a pyramid level is not negative")).isNull(), F.least(level, levels - 1))


def radius_px(radius_um: Column, mpp: Column) -> Column:
    """Whole pixels, half to even; at least one for a positive radius."""
    return F.when(radius_um <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(radius_um / mpp).cast("int")))


def tile_name(x: Column, y: Column) -> Column:
    return F.format_string("tile_x%06d_y%06d", x, y)


def confidence_byte(votes: Column, members: Column) -> Column:
    return F.floor(votes * 255 / members).cast("int")


def slide_seed(name: Column, base: int) -> Column:
    """A seed for each slide that does not depend on the others."""
    return F.crc32(name.cast("string").cast("binary")).bitwiseXOR(F.lit(base & 0xFFFFFFFF).cast("long"))


def sample_key(seed: int, *parts: Column) -> Column:
    """The order in which rows are drawn: equal in every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def natural_key(stem: Column) -> Column:
    """Sorts digits in a name by their value: a run of digits follows its length, zeros in front left out."""
    parts = F.regexp_extract_all(stem, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(F.lower(p))), "")


def json_digest(record: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.to_json(record).cast("binary"), 256), 1, digits)
