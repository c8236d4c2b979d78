"""Household arithmetic and wording: classes of sources, kits, supplies, doses, readings, facilities, opening hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The doses of children's medicines as their public leaflets have them: form, from and to months, amount, mg, doses.
DOSES = (
    ("paracetamol liquid 120", 2, 3, "2.5ml", "60mg", "2 doses in 24 hours", 4), ("paracetamol liquid 120", 3, 6, "2.5ml", "60mg", "4 doses in 24 hours", 4),
    ("paracetamol liquid 120", 6, 24, "5ml", "120mg", "4 doses in 24 hours", 4), ("paracetamol liquid 120", 24, 48, "7.5ml", "180mg", "4 doses in 24 hours", 4),
    ("paracetamol liquid 120", 48, 72, "10ml", "240mg", "4 doses in 24 hours", 4),
    ("paracetamol liquid 250", 72, 96, "5ml", "250mg", "4 doses in 24 hours", 4), ("paracetamol liquid 250", 96, 120, "7.5ml", "375mg", "4 doses in 24 hours", 4),
    ("paracetamol liquid 250", 120, 144, "10ml", "500mg", "4 doses in 24 hours", 4), ("paracetamol liquid 250", 144, 192, "10ml to 15ml", "500mg to 750mg", "4 doses in 24 hours", 4),
    ("paracetamol liquid 250", 192, 216, "10ml to 20ml", "500mg to 1g", "4 doses in 24 hours", 4),
    ("paracetamol melt 250", 72, 108, "1 tablet", "250mg", "4 doses in 24 hours", 4), ("paracetamol melt 250", 108, 144, "2 tablets", "500mg", "4 doses in 24 hours", 4),
    ("paracetamol melt 250", 144, 192, "2 or 3 tablets", "500mg to 750mg", "4 doses in 24 hours", 4), ("paracetamol melt 250", 192, 216, "2 to 4 tablets", "500mg to 1g", "4 doses in 24 hours", 4),
    ("ibuprofen liquid 100", 3, 6, "2.5ml", "50mg", "3 doses in 24 hours", 6), ("ibuprofen liquid 100", 6, 12, "2.5ml", "50mg", "3 to 4 doses in 24 hours", 6),
    ("ibuprofen liquid 100", 12, 48, "5ml", "100mg", "3 doses in 24 hours", 6), ("ibuprofen liquid 100", 48, 84, "7.5ml", "150mg", "3 doses in 24 hours", 6),
    ("ibuprofen liquid 100", 84, 120, "10ml", "200mg", "3 doses in 24 hours", 6), ("ibuprofen liquid 100", 120, 144, "15ml", "300mg", "3 doses in 24 hours", 6),
    ("ibuprofen tablet 200", 144, 216, "1 or 2 tablets", "200mg to 400mg", "3 doses in 24 hours", 6),
)
#: What a reading of 1 or more says, and of less.
FLAGS = {"up": "down", "on": "off", "present": "absent", "ok": "not ok", "open": "shut", "dry": "wet"}
DAYS = {"Mo": "Mon", "Tu": "Tue", "We": "Wed", "Th": "Thu", "Fr": "Fri", "Sa": "Sat", "Su": "Sun", "PH": "bank holidays"}
#: Tags of facilities (key, values), and what rules a place out.
FACILITIES = {
    "emergency-department": (("amenity", ("hospital",)),), "pharmacy": (("amenity", ("pharmacy",)),), "gp": (("amenity", ("doctors",)),), "fuel": (("amenity", ("fuel",)),),
    "water-works": (("man_made", ("water_works", "water_treatment", "wastewater_plant")),), "fire-station": (("amenity", ("fire_station",)),),
    "rest-centre": (("amenity", ("shelter", "community_centre")), ("emergency", ("assembly_point",))),
}
RULED_OUT = {"emergency-department": ("emergency", ("no",))}


def source_class(tier: Column, category: Column, item: Column) -> Column:
    """The class that a library item is ranked and shown in."""
    own = ("reference", "practical", "survival", "books")
    return (
        F.when(tier == "extended", "extended").when(category == "uk-official", category)
        .when((category == "medical") & F.startswith(item, F.lit("nhs")), "nhs").when((category == "medical") | category.isin(*own), category).otherwise("reference")
    )


def is_postcode(text: Column) -> Column:
    return text.rlike(r"(?i)^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$")


def is_district(text: Column) -> Column:
    return text.rlike(r"(?i)^[A-Z]{1,2}\d[A-Z\d]?$")


def facility(props: Column, name: str) -> Column:
    """Whether tags make a place a facility of this kind."""
    has = lambda key, values: F.coalesce(F.lower(F.try_element_at(props, F.lit(key))).isin(*values), F.lit(False))
    found = F.lit(False)
    for key, values in FACILITIES[name]:
        found = found | has(key, values)
    return found & ~has(*RULED_OUT[name]) if name in RULED_OUT else found


def number(x: Column, places: int = 2) -> Column:
    """Without needless decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string(f"%.{places}f", x), r"\.?0+$", ""))


def kit_quantity(amount: Column, unit: Column, per: Column, people: Column, days: Column) -> Column:
    """(total, text) of a kit's item for a household."""
    n = F.greatest(F.lit(1), people)
    total = F.when(per == "person-day", amount * n * days).when(per == "person", amount * n).otherwise(amount).cast("double")
    who = F.when(n == 1, "for 1 person").otherwise(F.concat(F.lit("for "), n.cast("string"), F.lit(" people")))
    text = F.concat_ws(" ", number(total), unit, F.when(per.isin("person-day", "person"), who), F.when(per == "person-day", F.concat(F.lit("over "), days.cast("string"), F.lit(" days"))))
    return F.struct(F.round(total, 2).alias("total"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def generator_hours(tank: Column, per_hour: Column) -> Column:
    return F.when((tank > 0) & (per_hour > 0), tank / per_hour)


def battery_hours(watt_hours: Column, load: Column, efficiency: float = 0.85) -> Column:
    return F.when((watt_hours > 0) & (load > 0), watt_hours * efficiency / load)


def solar_daily(watts: Column, month: Column) -> Column:
    """(low, high) watt-hours a day of a panel: 4 to 5 times its watts in June, 0.5 to 1 in December, in line between."""
    off = F.abs(month - 6)
    away = F.least(off, 12 - off)
    band = lambda june, december: F.floor(watts * (june - (june - december) * away / 6) + 0.5).cast("long")
    return F.when((watts > 0) & month.between(1, 12), F.struct(band(4.0, 0.5).alias("low"), band(5.0, 1.0).alias("high")))


def ration_days(quantity: Column, people: Column, per_person_day: Column) -> Column:
    return F.when((quantity >= 0) & (people > 0) & (per_person_day > 0), quantity / (people * per_person_day))


def doses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOSES), "form string, low int, high int, amount string, mg string, most string, every_hours int")


def reading_text(value: Column, unit: Column) -> Column:
    """A sensor's value in words."""
    on = value >= 1
    out = None
    for yes, no in FLAGS.items():
        word = F.when(on, yes).otherwise(no)
        out = F.when(unit == yes, word) if out is None else out.when(unit == yes, word)
    return out.otherwise(F.concat_ws(" ", number(F.floor(value * 10 + 0.5) / 10, 1), F.when(unit != "", unit)))


def reading_tone(sensor: Column, value: Column, unit: Column) -> Column:
    """Whether a reading says that something is wrong."""
    flag = F.when(value >= 1, "ok").otherwise("danger")
    gas = F.when(value >= 50, "danger").when(value >= 10, "warn").otherwise("ok")
    return F.when(unit.isin(*FLAGS), flag).when(sensor == "co_ppm", gas).when(sensor == "temp_in", F.when(value < 16, "warn").otherwise("ok")).otherwise("default")


def humanise(tag: Column) -> Column:
    """water_works as Water works."""
    words = F.trim(F.regexp_replace(tag, r"[_\s-]+", " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))


def opening_hours(value: Column) -> Column:
    """Tagged opening hours with days in words."""
    names = "|".join(DAYS)
    out = F.regexp_replace(value, rf"\b({names})-({names})\b", "$1 to $2")
    for short, name in DAYS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", name)
    out = F.regexp_replace(F.regexp_replace(out, r"\boff\b", "closed"), r";\s*", "; ")
    return F.when(F.trim(value) == "24/7", "Open 24 hours a day, every day").otherwise(out)


def pack_title(pack: Column) -> Column:
    """The name of a map pack."""
    dashes = lambda s: F.replace(s, F.lit("_"), F.lit(" – "))
    rest = lambda head: dashes(F.substr(pack, F.lit(len(head) + 1)))
    return F.when(F.startswith(pack, F.lit("UK_")), rest("UK_")).when(F.startswith(pack, F.lit("Ireland_")), F.concat(F.lit("Ireland – "), rest("Ireland_"))).otherwise(pack)
