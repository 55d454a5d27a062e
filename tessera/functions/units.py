"""Quantities in text as Column expressions: units, magnitudes, booleans, rendering."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of each canonical unit.
UNITS = {
    "degC": "c degc celsius °c f degf fahrenheit °f kelvin",
    "ms": "ms millisecond milliseconds msec s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months",
    "tps": "tps rps qps", "unit": "unit units pcs pieces", "vehicle": "vehicle vehicles", "user": "user users", "%": "% percent pct",
    "INR": "inr rs rs. rupee rupees ₹", "USD": "usd $ dollar dollars", "EUR": "eur €",
    "kWh": "kwh wh mwh", "kW": "kw w mw", "V": "v", "A": "a", "Ah": "ah", "kg": "g kg t tonne tonnes", "m": "mm cm m km",
}
#: How much of its canonical unit a spelling is.
FACTORS = {
    "ms": 1.0, "s sec secs second seconds": 1e3, "min mins minute minutes": 6e4, "h hr hrs hour hours": 3.6e6, "day days": 8.64e7, "week weeks": 6.048e8, "month months": 2.592e9,
    "g": 1e-3, "kg": 1.0, "t tonne tonnes": 1e3, "mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1e3, "w": 1e-3, "kw": 1.0, "mw": 1e3, "wh": 1e-3, "kwh": 1.0, "mwh": 1e3,
}
#: Words for magnitudes, for true and for false.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "mn": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9, "lakh": 1e5, "lac": 1e5, "lakhs": 1e5, "crore": 1e7, "crores": 1e7}
TRUE = "true yes supported enabled active compliant available".split()
FALSE = "false no unsupported disabled inactive deprecated non-compliant unavailable removed".split()
_NUMBER = r"(?i)([-+])?\s*(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(k|m|mn|bn|b|lakhs?|lac|crores?|thousand|million|billion)?\b"


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for keys, v in values.items() for k in keys.split() for x in (k, v)))


def _alias(token: Column) -> Column:
    return F.element_at(_map({v: k for k, v in UNITS.items()}), token)


def canonical_unit(raw: Column) -> Column:
    """The unit that all spellings of a family share; unknown ones stay, rates are split at the slash; null and empty are null."""
    u = F.replace(F.replace(F.lower(F.trim(raw)), F.lit("per "), F.lit("/")), F.lit(" "), F.lit(""))
    top = F.substring_index(u, "/", 1)
    bare = F.regexp_replace(top, "s+$", "")
    rate = F.concat_ws("/", F.coalesce(_alias(top), F.when(bare == "", top).otherwise(bare)), F.regexp_replace(F.regexp_replace(u, "^[^/]*/", ""), "s+$", ""))
    return F.when(u.isNull() | (u == ""), None).when(F.contains(u, F.lit("/")), rate).otherwise(F.coalesce(_alias(u), F.trim(raw)))


def _converted(number: Column, token: Column, unit: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(token)), "^°+", "")
    degrees = F.when(t.isin("f", "degf", "fahrenheit"), (number - 32) * 5 / 9).when(t == "kelvin", number - 273.15).otherwise(number)
    return F.when(unit == "degC", degrees).otherwise(number * F.coalesce(F.element_at(_map(FACTORS), t), F.lit(1.0)))


def parse_value(raw: Column, hint: Column | None = None) -> Column:
    """struct(raw, number, unit, boolean, text) of a text such as '50k units per month', '158 F' or 'deprecated'; hint: a unit told beside it.

    Numbers are in the canonical unit of their family. Null and empty texts give nulls but for raw; texts without a number keep text."""
    hint = F.lit(None).cast("string") if hint is None else hint
    text = F.trim(F.coalesce(raw, F.lit("")))
    low = F.regexp_replace(F.lower(text), r"^[ .]+|[ .]+$", "")
    truth = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    part = lambda i: F.regexp_extract(text, rf"(?s)^(.*?){_NUMBER}(.*)$", i)
    found = F.regexp_like(text, F.lit(_NUMBER))
    size = F.coalesce(F.element_at(_map(MAGNITUDES), F.lower(part(4))), F.lit(1.0))
    number = F.replace(part(3), F.lit(","), F.lit("")).try_cast("double") * F.when(part(2) == "-", -1.0).otherwise(1.0) * size
    tail, lead = F.trim(F.regexp_extract(F.trim(part(5)), r"(?s)^(.*?)(?:[,;()]| and | or |$)", 1)), F.trim(part(1))
    token = F.coalesce(F.nullif(tail, F.lit("")), F.nullif(lead, F.lit("")), hint, F.lit(""))
    unit = F.coalesce(canonical_unit(token), canonical_unit(hint))
    told = F.when((token != "") & ~F.contains(F.lower(text), F.lower(token)), F.concat_ws(" ", text, token)).otherwise(text)
    numeric = found & truth.isNull() & (text != "")
    return F.struct(
        F.when(numeric, told).otherwise(text).alias("raw"), F.when(numeric, _converted(number, F.substring_index(token, "/", 1), unit)).alias("number"),
        F.when(numeric, unit).when(truth.isNull() & (text != ""), canonical_unit(hint)).alias("unit"), F.when(text != "", truth).alias("boolean"),
        F.when(truth.isNotNull(), low).when(~numeric & (text != ""), text).alias("text"),
    )


def render(value: Column) -> Column:
    """A parsed value for reading: as its source put it, else number and unit; truth as yes or no."""
    plain = F.regexp_replace(F.regexp_replace(F.call_function("format_number", value["number"], F.lit("#,###.##########")), r"^\.", "0."), r"^-\.", "-0.")
    return F.coalesce(F.when(value["boolean"].isNotNull(), F.when(value["boolean"], "yes").otherwise("no")), F.when(value["number"].isNotNull(), F.concat_ws(" ", plain, value["unit"])), value["text"], value["raw"])
