"""Text windows, canonical names, hashes and JSON facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none_in(text: Column, words) -> Column:
    return reduce(lambda a, b: a & b, [F.instr(text, w) == 0 for w in words])


# Window sizes and the words that break the reading.
AFTER, BEFORE = 70, 60
BREAKS = ('"', ".", ";", " & ", "<br", "</p>")
OTHER_ROOMS = ("bedroom", "bathroom", "shower room", "cloakroom", "utility", "garden", "balcony", "terrace", "hallway",
               "entrance", "suite", "study", "garage", "parking", "storage")
ASPIRES = ("potential to", "scope to", "opportunity to", "could be made", "could be turned")


def phrase_then(text: Column, first: str, second: str, after: int = AFTER, before: int = BEFORE,
                stops=(*BREAKS, *OTHER_ROOMS), cues=ASPIRES) -> Column:
    """`first`, then `second` within `after` characters, no stop between them and no cue in the `before` characters ahead."""
    t = F.lower(F.coalesce(text, F.lit("")))
    at = F.instr(t, first)
    window = t.substr(at + len(first), F.lit(after))
    to = F.instr(window, second)
    between = window.substr(F.lit(1), F.greatest(to - 1, F.lit(0)))
    ahead = t.substr(F.greatest(at - before, F.lit(1)), F.lit(before))
    return (at > 0) & (to > 0) & _none_in(between, stops) & _none_in(ahead, cues)


def one_spelling(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "open-plan|openplan", "open plan")


def open_plan_kitchen(text: Column) -> Column:
    return phrase_then(one_spelling(text), "open plan", "kitchen")


def json_fact(doc: Column, path: str, fallback: Column | None = None) -> Column:
    """Number at $.path.value; the stored column wins where it is present and not zero."""
    read = F.get_json_object(doc, f"$.{path}.value").try_cast("double")
    return read if fallback is None else F.coalesce(F.nullif(fallback, F.lit(0.0)), F.nullif(read, F.lit(0.0)))


def reduced_on(reason: Column) -> Column:
    """Date inside 'Reduced on dd/mm/yyyy'."""
    return F.when(reason.startswith("Reduced on "), F.try_to_date(F.substring(reason, 12, 10), "dd/MM/yyyy"))


def tier(raw: Column) -> Column:
    """Half-up tier clamped to 1..10."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.floor(raw.cast("double") + 0.5).cast("int")))


def bare_name(raw: Column) -> Column:
    """Lower case, no apostrophes, no station-like ending."""
    t = F.regexp_replace(F.lower(F.trim(raw)), "['’]", "")
    return F.trim(F.regexp_replace(t, r"( station| rail| underground| tube)+$", ""))


def _prefixes(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))


def canonical_names(names: DataFrame, col: str, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical spelling: exact, then alias, then a prefix that fits one entry only, else the input.

    vocabulary(name), aliases(alias, name). A prefix fit is an equality on the prefixes of either side.
    """
    voc = vocabulary.select(F.col("name").alias("v_name"), bare_name(F.col("name")).alias("v_bare"))
    ali = aliases.select(bare_name(F.col("alias")).alias("a_bare"), F.col("name").alias("a_name"))
    base = names.select(col).distinct().withColumn("bare", bare_name(F.col(col)))
    exact = base.join(voc, F.col("bare") == F.col("v_bare"), "left").join(ali, F.col("bare") == F.col("a_bare"), "left")
    known = exact.select(col, "bare", F.coalesce("v_name", "a_name").alias("known"))
    open_names = known.where("known IS NULL AND bare <> ''").select(col, "bare")
    longer = open_names.join(voc.select(F.col("v_name").alias("p_name"), F.explode(_prefixes(F.col("v_bare"))).alias("bare")), "bare")
    shorter = open_names.select(col, F.explode(_prefixes(F.col("bare"))).alias("v_bare")).join(voc, "v_bare")
    fits = longer.select(col, "p_name").unionByName(shorter.select(col, F.col("v_name").alias("p_name"))).distinct()
    fits = fits.groupBy(col).agg(F.count(F.lit(1)).alias("fits"), F.min("p_name").alias("fit"))
    found = known.join(fits, col, "left").select(col, F.coalesce("known", F.when(F.col("fits") == 1, F.col("fit")), F.col(col)).alias("canonical"))
    return names.join(found, col)


def content_key(*parts: Column) -> Column:
    """First twelve hex digits of the SHA-1 of the squeezed, lower-cased parts."""
    squeezed = [F.trim(F.regexp_replace(F.lower(F.coalesce(p, F.lit(""))), r"\s+", " ")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *squeezed)), 1, 12)


def tool_count(doc: Column) -> Column:
    """Length of a JSON list or object; unreadable text counts none."""
    return F.coalesce(F.json_array_length(doc), F.size(F.json_object_keys(doc)), F.lit(0))
