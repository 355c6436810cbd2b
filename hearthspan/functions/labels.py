"""Words of listings, rooms and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that are neither flat nor house, and the words of a flat.
OTHER_TYPES = (
    "house boat", "house share", "flat share", "off-plan", "block of apartments", "retirement property", "hotel room",
    "serviced apartments", "residential development", "house of multiple occupation", "equestrian facility",
    "park home", "mobile home", "land", "plot", "garages", "parking", "not specified", "",
    "office", "serviced office", "commercial property", "commercial development",
    "retail property (high street)", "retail property (out of town)", "shop", "mixed use", "restaurant", "cafe", "takeaway",
    "pub", "bar / nightclub", "hotel", "guest house", "warehouse", "distribution warehouse", "industrial",
    "light industrial", "heavy industrial", "workshop", "showroom", "storage", "business park", "trade counter",
    "healthcare facility", "leisure facility", "place of worship", "childcare facility", "petrol station", "post office",
    "hairdresser / barber shop", "convenience store", "data centre", "science park", "farm", "smallholding", "campsite", "farm land",
)
FLAT_WORDS = ("flat", "apartment", "maisonette", "penthouse", "studio", "duplex", "triplex")
# Wording that says flat, house or whole building.
SAYS_FLAT = r"maisonette|bedroom apartment|floor apartment|this apartment"
SAYS_HOUSE = (
    r"\b(?:(?:terraced|semi[- ]detached|detached|end[- ]of[- ]terrace)\s+(?!maisonette|garden)"
    r"|town\s?house|mews house|family home|bedroom house|bedroom home|freehold house|coach house|this house\b|cottage\b|bungalow\b)"
)
SAYS_BUILDING = (
    r"arranged as|converted into|split into"
    r"|comprising\s+(?:two|three|four|five|six|\d+)\s+(?:self[- ]contained\s+)?(?:flats|apartments|maisonettes)"
    r"|freehold (?:building|block|investment)|whole building|self[- ]contained"
)


def property_kind(label: Column) -> Column:
    """flat, house or other; the other list wins, an unknown label is a house, a missing one other."""
    t = F.lower(F.trim(label))
    return F.when(label.isNull() | t.isin(*OTHER_TYPES), "other").when(t.rlike("|".join(FLAT_WORDS)), "flat").otherwise("house")


def bucket_of_two(label: Column) -> Column:
    t = F.lower(label)
    return F.when(t.rlike("flat|apartment|maisonette|penthouse|studio"), "flat").when(
        t.rlike("house|terrac|detached|semi|bungalow|cottage|mews"), "house")


def bucket_of_five(label: Column) -> Column:
    """First bucket whose word occurs wins, so semi-detached is semi."""
    t = F.lower(label)
    return (
        F.when(t.rlike("flat|apartment|maisonette|penthouse|studio"), "flat").when(t.contains("terraced"), "terraced")
        .when(t.contains("semi"), "semi").when(t.contains("detached"), "detached").when(t.rlike("bungalow|cottage|mews"), "other")
    )


def type_codes(text: Column) -> Column:
    """Ledger codes of free text, or NULL for no filter."""
    t = F.lower(F.trim(text))
    flat = t.rlike("flat|apartment|maisonette|studio|penthouse")
    house = t.rlike("house|terrace|semi|detached|bungalow|mews|cottage")
    return F.when(t.isin("f", "t", "s", "d", "o"), F.array(F.upper(t))).when(flat, F.array(F.lit("F"))).when(
        house, F.array(F.lit("D"), F.lit("S"), F.lit("T")))


def plain_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")


def reads_as_flat(text: Column) -> Column:
    """The snippet (40 characters either side) in which a listing calls itself a flat; NULL if it does not or is ambiguous."""
    t = plain_text(text)
    hit = F.regexp_extract(t, f"(?i)({SAYS_FLAT})", 1)
    at = F.instr(t, hit)
    unclear = t.rlike(f"(?i){SAYS_HOUSE}") | t.rlike(f"(?i){SAYS_BUILDING}")
    start = F.greatest(F.lit(1), at - 40)
    return F.when((hit != "") & ~unclear, F.trim(t.substr(start, at - start + F.length(hit) + 40)))


# Outdoor nouns and the words that make a label a room.
OUTDOOR_NOUN = (
    r"\b(gardens?|patios?|courtyards?|terraces?|balcon(?:y|ies)|decking|deck|yards?|"
    r"verandah?s?|driveways?|drive|drive way|forecourts?|decked|parking|lawns?|flat roof)\b"
)
INDOOR_WORD = (
    r"\b(rooms?|office|studio|house|store|storage|shed|cabin|bar|gym|pod|kitchen|living|"
    r"lounge|bedroom|reception|dining|study|loft|landing|hall|hallway|bathroom|utility|conservatory|orangery|winter|garage)\b"
)
OUTDOOR_TYPES = ("balcony", "terrace", "garden", "patio", "outdoor", "roof_terrace", "veranda")


def outdoor_kind(room_type: Column, label: Column) -> Column:
    """A typed outdoor room keeps its type; an untyped one is read from the label before its first digit."""
    head = F.split(F.lower(F.coalesce(label, F.lit(""))), r"\d", 2)[0]
    nouns = F.regexp_extract_all(head, F.lit(OUTDOOR_NOUN), 1)
    outdoors = (F.size(nouns) > 0) & ~head.rlike(INDOOR_WORD)
    untyped = room_type.isNull() | room_type.isin("", "other")
    starts = lambda *words: F.forall(nouns, lambda x: F.reduce(F.array(*[x.startswith(w) for w in words]), F.lit(False), lambda a, b: a | b))
    read = (
        F.when(starts("balcon"), "balcony")
        .when(starts("terrace", "patio"), F.when(F.exists(nouns, lambda x: x.startswith("terrace")), "terrace").otherwise("patio"))
        .otherwise("outdoor")
    )
    return F.when(room_type.isin(*OUTDOOR_TYPES), room_type).when(untyped & outdoors, read)


# Rooms named after a garden, and shared gardens.
GARDEN_ROOM = r"\bgardens?\s+(room|office|studio|store|shed|house|cabin|bar|gym)\b"
GARDEN_SHARED = r"\b(communal|shared|residents|winter|roof)\s+gardens?\b"
# How room labels print areas and sides, and words for irregular rooms.
PRINTED_M2 = r"(?i)(\d+(?:\.\d+)?)\s*(?:m\s*²|m2|sq\s*m|sqm)"
IRREGULAR = r"(?i)\b(max|maximum|into\s*bay|into\s*recess|excluding|irregular)\b"
METRIC_SIDE = r"(?<![\d.])(\d+\.\d{1,2})(?![\d.])"
FEET_SIDE = "(\\d+\\s*['′]\\s*\\d*)\\s*[\"″]?"


def garden_label(label: Column) -> Column:
    """The home's own garden, not a garden room or a shared one."""
    t = F.lower(label)
    return F.coalesce(t.rlike(r"\bgardens?\b") & ~t.rlike(GARDEN_ROOM) & ~t.rlike(GARDEN_SHARED), F.lit(False))


def room_area(label: Column) -> Column:
    """Struct (area_sqft, tier, shape, method, long_edge_m) read from a room label.

    Printed square metres first, then metric sides, then feet and inches; irregular rooms count 0.82.
    Each reading is bound once: written out where it is used, the regular expressions would run over and over.
    """
    t = F.trim(label)
    printed = F.regexp_extract(t, PRINTED_M2, 1).try_cast("double")
    bent = t.rlike(IRREGULAR)
    factor = F.when(bent, 0.82).otherwise(1.0)
    metric = F.transform(F.regexp_extract_all(t, F.lit(METRIC_SIDE), 1), lambda x: x.cast("double"))
    feet_text = F.regexp_extract_all(t, F.lit(FEET_SIDE), 1)
    feet = F.transform(
        feet_text,
        lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("double")
        + F.coalesce(F.when(F.regexp_extract(x, r"['′]\s*(\d+)$", 1) != "", F.regexp_extract(x, r"['′]\s*(\d+)$", 1)).cast("double"), F.lit(0.0)) / 12,
    )

    def first_sides(nums: Column, low: float, high: float) -> Column:
        beside = F.arrays_zip(F.slice(nums, 1, F.greatest(F.size(nums) - 1, F.lit(0))).alias("w"), F.slice(nums, 2, F.greatest(F.size(nums) - 1, F.lit(0))).alias("h"))
        fits = F.filter(beside, lambda s: s["w"].between(low, high) & s["h"].between(low, high))
        return F.try_element_at(fits, F.lit(1))

    def bound(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    shape = F.when(bent, "irregular").otherwise("rectangular")
    tier = F.when(bent, 3).otherwise(2)

    def made(area, level, kind, method, edge):
        return F.struct(F.round(area).cast("bigint").alias("area_sqft"), level.alias("tier"), kind.alias("shape"), F.lit(method).alias("method"), edge.cast("double").alias("long_edge_m"))

    by_feet = bound(bound(feet, lambda x: first_sides(x, 2, 80)), lambda f: F.when(f.isNotNull(), made(f["w"] * f["h"] * factor, tier, shape, "imperial_dims", F.round(F.greatest(f["w"], f["h"]) * 0.3048, 2))))
    by_metres = bound(bound(metric, lambda x: first_sides(x, 0.8, 30)), lambda m: F.when(m.isNotNull(), made(m["w"] * m["h"] * 10.764 * factor, tier, shape, "metric_dims", F.round(F.greatest(m["w"], m["h"]), 2))).otherwise(by_feet))
    return bound(printed, lambda p: F.when(p.between(1, 200), made(p * 10.764, F.lit(1), F.lit("exact"), "printed_m2", F.lit(None))).otherwise(by_metres))


# Unit words, leading numbers, endings of building and street names.
UNIT = r"(?:FLAT|UNIT|APARTMENT|APT)\s*(\d+[A-Z]?)"
UNIT_LED = r"^(?:FLAT|UNIT|APARTMENT|APT)\s*\d+"
LED_NUMBER = r"^(\d+[A-Z]?)\s*[,\s]\s*[A-Z]"
BUILDING = r"([A-Z][A-Z\s]+(?:TOWER|APARTMENTS|HOUSE|COURT|MANSIONS|LODGE|HALL|BUILDING|POINT|HEIGHTS))"
BUILDING_WIDE = r"([A-Z][A-Z\s]+(?:SQUARE|GARDENS|TERRACE|MEWS|RISE|VIEW|WALK)S?)\b"
STREET = r"([A-Z][A-Z\s]+(?:ROAD|STREET|LANE|AVENUE|WAY|DRIVE|CLOSE|CRESCENT|GROVE|PLACE|HILL))\b"
SUFFIXES = ("TOWER", "APARTMENTS", "HOUSE", "COURT", "MANSIONS", "LODGE", "HALL", "BUILDING", "POINT", "HEIGHTS",
            "SQUARE", "GARDENS", "TERRACE", "MEWS", "THE", "OF", "AT")


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def with_address_features(df: DataFrame, address: str, out: str) -> DataFrame:
    """Add struct `out` (unit_number, building_name, street_number, street_name) and `out`_key.

    Each reading becomes a column of its own before the next one uses it: nested in one expression the
    regular expressions would be evaluated over and over.
    """
    d = df.withColumn("_a", F.upper(F.trim(F.col(address))))
    a = F.col("_a")
    building = F.coalesce(_or_null(F.regexp_extract(a, BUILDING, 1)), _or_null(F.regexp_extract(a, BUILDING_WIDE, 1)))
    d = d.withColumn("_segs", F.transform(F.split(a, ","), lambda s: F.trim(s))).withColumn("_b", F.trim(F.regexp_replace(building, r"\s+", " ")))
    segs, b = F.col("_segs"), F.col("_b")
    d = d.withColumn("_named", _or_null(F.regexp_extract(a, UNIT, 1)))
    d = d.withColumn("_lead", _or_null(F.regexp_extract(a, LED_NUMBER, 1)))
    d = d.withColumn("_gap", F.regexp_extract(a, r"^\d+[A-Z]?(\s*[,\s]\s*)", 1))
    ahead = F.when(F.instr(a, b) == F.length("_lead") + F.length("_gap") + 1, F.col("_lead"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1))), lambda i: F.try_element_at(segs, i).rlike(r"^\d+[A-Z]?$") & F.contains(F.try_element_at(segs, i + 1), b))
    d = d.withColumn("_before", F.when(b.isNotNull() & F.col("_named").isNull(), F.try_element_at(segs, F.try_element_at(at, F.lit(1)))))
    d = d.withColumn("_unit", F.coalesce("_named", ahead, "_before"))
    unit = F.col("_unit")
    d = d.withColumn("_rest", F.filter(segs, lambda s: ~s.rlike(UNIT_LED) & (unit.isNull() | (s != unit)) & (b.isNull() | ~F.contains(s, b))))
    d = d.withColumn("_first", F.try_element_at(F.filter("_rest", lambda s: s.rlike(r"^\d+[A-Z]?\s+" + STREET)), F.lit(1)))
    d = d.withColumn("_any", F.try_element_at(F.filter("_rest", lambda s: s.rlike(r"\b" + STREET)), F.lit(1)))
    d = d.withColumn("_name", F.coalesce(_or_null(F.regexp_extract("_first", r"^\d+[A-Z]?\s+" + STREET, 1)), _or_null(F.regexp_extract("_any", r"\b" + STREET, 1))))
    name = F.col("_name")
    d = d.withColumn("_at", F.array_position(F.transform(segs, lambda s: F.contains(s, name)), F.lit(True)).cast("int"))
    d = d.withColumn("_b_at", F.array_position(F.transform(segs, lambda s: F.contains(s, b)), F.lit(True)).cast("int"))
    own = F.try_element_at(segs, F.col("_at") - 1)
    after = F.filter(F.slice(segs, F.greatest(F.col("_b_at"), F.lit(1)) + 1, F.greatest(F.size(segs), F.lit(1))), lambda s: s.rlike(r"^\d+[A-Z]?$"))
    number = F.coalesce(
        _or_null(F.regexp_extract("_first", r"^(\d+[A-Z]?)\s+" + STREET, 1)),
        F.when(b.isNotNull() & (F.col("_b_at") > 0), F.try_element_at(after, F.lit(1))),
        F.when(name.isNotNull() & unit.isNull() & (F.col("_at") > 1) & own.rlike(r"^\d+[A-Z]?$"), own),
    )
    d = d.withColumn("_no", number)
    first = _or_null(F.regexp_extract(F.split(a, ",")[0], r"\b(\d+[A-Z]?)\b", 1))
    d = d.withColumn(out, F.struct(unit.alias("unit_number"), b.alias("building_name"), F.col("_no").alias("street_number"), F.trim(name).alias("street_name")))
    # matching key: FLATn, else street number, else the first number of the first segment
    d = d.withColumn(f"{out}_key", F.coalesce(F.concat(F.lit("FLAT"), unit), F.col("_no"), first))
    return d.drop("_a", "_segs", "_b", "_named", "_lead", "_gap", "_before", "_unit", "_rest", "_first", "_any", "_name", "_at", "_b_at", "_no")


def match_score(a: Column, b: Column) -> Column:
    """0..5 agreement of two feature structs; differing units or building names are no match."""
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    generic = F.array(*[F.lit(s) for s in SUFFIXES])
    wa, wb = (F.array_except(F.split(x["building_name"], " "), generic) for x in (a, b))
    bare = lambda w: F.size(w) == 0
    clash = both("building_name") & ((bare(wa) != bare(wb)) | (~bare(wa) & ~bare(wb) & ~F.arrays_overlap(wa, wb)))
    named = both("building_name") & F.arrays_overlap(wa, wb)
    sa, sb = a["street_name"], b["street_name"]
    one = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0)
    score = (
        one(both("unit_number"), 2) + one(named, 1)
        + one(both("street_number") & (a["street_number"] == b["street_number"]), 1)
        + one(both("street_name") & (F.contains(sa, sb) | F.contains(sb, sa)), 1)
    )
    differ = both("unit_number") & (a["unit_number"] != b["unit_number"])
    return F.when(F.coalesce(differ, F.lit(False)) | F.coalesce(clash, F.lit(False)), 0).otherwise(score)
