"""Scalar functions of the media model as Column expressions. All are null-safe: a null argument gives null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that a scan takes, and the sides and quality of a thumbnail.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "heic", "heif")
THUMB_SIDE = 384
EARTH_RADIUS_KM = 6_371.0


def basename(path: Column) -> Column:
    """The part after the last slash or backslash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot starts a name, not an extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))


def year_of(seconds: Column) -> Column:
    """The UTC calendar year of epoch seconds as text; null counts as 0; times before 1970 are right, too."""
    return F.year(F.timestamp_seconds(F.coalesce(seconds, F.lit(0)))).cast("string")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def placeholder_hash(path: Column) -> Column:
    """Stands for the content of a file that cannot be read."""
    return F.sha2(F.concat(F.lit("failed:"), path), 256)


def thumb_key(sha: Column) -> Column:
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(".jpg"))


def fit_within(width: Column, height: Column, side: int = THUMB_SIDE) -> tuple[Column, Column]:
    """Size of a picture fitted into a square without enlarging it; at least one pixel each way; nulls stay null."""
    longest = F.greatest(width, height)
    scale = F.when(longest > side, F.lit(float(side)) / longest).otherwise(F.lit(1.0))
    known = width.isNotNull() & height.isNotNull()
    return tuple(F.when(known, F.greatest(F.round(c * scale), F.lit(1.0)).cast("int")) for c in (width, height))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Whole seconds left at the present pace; null before the first and after the last item."""
    return F.when((done > 0) & (done < total), F.floor(elapsed * (total - done) / done).cast("long"))


def valid_object_key(key: Column) -> Column:
    """Letters, digits and . _ - / only, no leading slash, no parent step."""
    return key.rlike(r"^[A-Za-z0-9._/-]+$") & ~key.startswith("/") & ~key.contains("..")


def under_folder(path: Column, folder: Column) -> Column:
    """Whether a path lies in a folder, by whole path components; an empty folder path holds nothing."""
    bare = F.regexp_replace(folder, r"[\\/]+$", "")
    return (F.length(bare) > 0) & ((path == bare) | path.startswith(F.concat(bare, F.lit("/"))) | path.startswith(F.concat(bare, F.lit("\\"))))


def exif_json(taken_at: Column, orientation: Column) -> Column:
    """JSON of the known fields; null where neither is known."""
    return F.when(taken_at.isNotNull() | orientation.isNotNull(), F.to_json(F.struct(taken_at.alias("taken_at"), orientation.alias("orientation"))))


def exif_seconds(text: Column) -> Column:
    """Epoch seconds of an EXIF 'YYYY:MM:DD HH:MM:SS', read as UTC; null where it does not parse."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def exif_fields(exif: Column) -> tuple[Column, Column]:
    """(taken_at, orientation) of a stored exif JSON; both null for broken JSON; orientation only from 1 to 8."""
    parsed = F.from_json(exif, "taken_at long, orientation int")
    return parsed.taken_at, F.when(parsed.orientation.between(1, 8), parsed.orientation)


def filename_seconds(path: Column) -> Column:
    """Epoch seconds of a 20YYMMDD_HHMMSS in a file name, read as UTC; null where there is none or it is no time."""
    text = F.regexp_extract(basename(path), r"(20\d{6}_\d{6})", 1)
    return F.unix_seconds(F.try_to_timestamp(F.when(text != "", text), F.lit("yyyyMMdd_HHmmss")))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null or NaN coordinates give null."""
    known = [c.isNotNull() & ~F.isnan(c) for c in (lat1, lng1, lat2, lng2)]
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(known[0] & known[1] & known[2] & known[3], 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); null where the union is empty."""
    zero = F.lit(0)
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero)
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    inter = (wide * high).cast("double")
    area = lambda c: ((c[2] - c[0]) * (c[3] - c[1])).cast("double")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union)


# Vectors as arrays of double.


def usable(v: Column, dim: int) -> Column:
    """``dim`` finite components, not all zero."""
    finite = F.size(F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))) == dim
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit vector as array<double>; null for a vector whose norm is 0, infinite or not a number."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n) & (n != float("inf")), F.transform(v, lambda x: x.cast("double") / n))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    """Cosine of unit vectors at a distance, from 0 to 1."""
    return F.greatest(F.least(1 - distance * distance / 2, F.lit(1.0)), F.lit(0.0))


def quantise(v: Column) -> Column:
    """Components times 127, halves away from zero, kept within -128 and 127."""
    return F.transform(v, lambda x: F.greatest(F.least(F.round(x * 127), F.lit(127)), F.lit(-128)).cast("int"))


def dequantise(q: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") / 127)


# Cursors and queries, on the driver.


def parse_cursor(text: str | None) -> tuple[int, int] | None:
    """(taken_at, asset_id) of 'taken_at:asset_id'; None, that is the first page, for anything else."""
    m = re.fullmatch(r"(-?\d+):(-?\d+)", text or "")
    return (int(m[1]), int(m[2])) if m else None


def format_cursor(taken_at: int, asset_id: int) -> str:
    return f"{taken_at}:{asset_id}"


def query_terms(text: str) -> list[str]:
    """The terms of a full-text query: split at white space, quotation marks dropped, in lower case; every one is plain text."""
    return [t for t in (part.replace('"', "").lower() for part in text.split()) if t]
