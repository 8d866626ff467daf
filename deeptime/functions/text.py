"""Text functions: slugs, search tokens, hues, coordinates, importance."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition does not reduce to ASCII.
LIGATURES = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}

#: Latin letters with marks and what is left without the marks, by the rule of canonical decomposition.
_MARKED = {c: b for c in map(chr, range(0xC0, 0x1F00)) if len(b := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and b.isascii() and b != c}


def strip_marks(text: Column) -> Column:
    """Letters without their marks, precomposed or combining."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}+", "")


def slugify(name: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, 80 characters at most."""
    for mark, plain in LIGATURES.items():
        name = F.replace(name, F.lit(mark), F.lit(plain))
    dashed = F.trim(F.regexp_replace(F.lower(strip_marks(name)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(dashed, 1, 80), F.lit("-"))


def search_tokens(slug: Column) -> Column:
    return F.filter(F.split(slug, "-"), lambda x: F.length(x) >= 3)


def hue(name: Column) -> Column:
    """FNV-1a over the UTF-16 code units of a name, modulo 360."""
    hexed = F.hex(F.encode(name, "UTF-16BE"))
    units = F.transform(F.filter(F.split(F.regexp_replace(hexed, "(.{4})", "$1 "), " "), lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("bigint"))
    h = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda a, u: (a.bitwiseXOR(u) * 16777619) % F.lit(4294967296))
    return h % 360


def importance(links: Column) -> Column:
    raw = F.least(F.lit(0.90), F.greatest(F.lit(0.22), 0.22 + 0.09 * F.log(1.0 + links)))
    return F.floor(raw * 100 + 0.5) / 100.0


def valid_lon_lat(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def point_wkt(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of ``Point(lon lat)``; null unless both are in range."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^Point\({number} {number}\)$"
    lon, lat = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    ok = valid_lon_lat(lon, lat)
    return F.when(ok, lon), F.when(ok, lat)


def entity_id(text: Column) -> Column:
    return text.rlike("^Q[1-9][0-9]*$")
