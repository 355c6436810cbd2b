"""UK postcode expressions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: covered postal areas.
COVERED = ("EC", "WC", "NW", "SE", "SW", "E", "N", "W", "BR", "CR", "DA", "EN", "HA", "IG", "KT", "RM", "SM", "TW", "UB", "WD")
# Districts and prefixes of the area types.
HUB_DISTRICTS = ("N1C", "W2", "SW1", "SE1", "NW1", "E1")
CENTRAL = ("EC", "WC")
OUTER = ("RM", "IG", "DA", "BR", "CR", "SM", "KT", "TW", "UB", "HA", "EN", "WD")


def compact(pc: Column) -> Column:
    return F.upper(F.regexp_replace(pc, r"\s+", ""))


def normalise(pc: Column) -> Column:
    """Upper case with one space before the three-character inward part."""
    c = compact(pc)
    return F.when(F.length(c) < 5, c).otherwise(F.concat_ws(" ", c.substr(F.lit(1), F.length(c) - 3), c.substr(F.length(c) - 2, F.lit(3))))


def extract(text: Column) -> Column:
    """First postcode in free text, normalised; NULL when there is none."""
    # fixed value: the shape of a unit postcode in running text
    hit = F.regexp_extract(F.upper(text), r"\b([A-Z]{1,2}[0-9][0-9A-Z]?\s*[0-9][A-Z]{2})\b", 1)
    return F.when(hit != "", normalise(hit))


def scope(raw: Column) -> Column:
    """unit, sector or outcode. The inner space decides: 'N19' is an outcode, 'N1 9' a sector."""
    t = F.trim(F.regexp_replace(F.upper(raw), r"\s+", " "))
    # fixed values: the shapes of unit, sector and unspaced unit
    return F.when(t.rlike(r"^\S+ \d[A-Z]{2}$"), "unit").when(t.rlike(r"^\S+ \d$"), "sector").when(
        ~t.contains(" ") & t.rlike(r"^[A-Z]{1,2}\d{1,2}[A-Z]?\d[A-Z]{2}$"), "unit"
    ).otherwise("outcode")


def parts(pc: Column) -> Column:
    """Struct of outcode, sector and inward digit; NULL fields when not a full unit."""
    c = compact(pc)
    shape = r"^([A-Z]{1,2}\d[A-Z\d]?)(\d)([A-Z]{2})$"
    # fixed value: `shape` is the outward code and the sector digit
    out, digit = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    ok = out != ""
    return F.struct(
        F.when(ok, out).alias("outcode"), F.when(ok, F.concat_ws(" ", out, digit)).alias("sector"), F.when(ok, digit).alias("digit")
    )


def postal_area(pc: Column) -> Column:
    """Leading letters."""
    return F.regexp_extract(compact(pc), r"^([A-Z]+)", 1)


def covered(pc: Column) -> Column:
    """Inside the covered areas; a value with no recognisable area counts as covered."""
    area = postal_area(pc)
    odd = (area == "") | (F.length(area) > 2)
    return F.when(pc.isNull() | odd, True).otherwise(area.isin(*COVERED))


def area_type(pc: Column) -> Column:
    """central_commercial, major_hub, residential or urban; E1 never swallows E15."""
    c = compact(pc)
    hub = F.lit(False)
    for district in HUB_DISTRICTS:
        hub = hub | c.rlike(f"^{district}(?:$|[^0-9])")
    return (
        F.when(pc.isNull() | (c == ""), "urban").when(c.rlike(f"^({'|'.join(CENTRAL)})"), "central_commercial").when(hub, "major_hub")
        .when(c.rlike(f"^({'|'.join(OUTER)})"), "residential").otherwise("urban")
    )
