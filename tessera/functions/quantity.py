"""Quantities as Column expressions: comparison, change, constraints, credibility axes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE, HALF_LIFE = 0.02, 120.0


def same_family(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def relative_delta(old: Column, new: Column) -> Column:
    """(new - old) / |old|; from 0: null to 0, else 1."""
    return F.when(old == 0, F.when(new != 0, F.lit(1.0))).otherwise((new - old) / F.abs(old))


def satisfies(value: Column, operator: Column, bound: Column) -> Column:
    """Three-valued: null where the values are missing or the operator unknown."""
    eq = F.abs(value - bound) < 1e-9
    out = F.when(operator == "LT", value < bound).when(operator == "LTE", value <= bound).when(operator == "GT", value > bound).when(operator == "GTE", value >= bound).when(operator == "EQ", eq)
    return out.when(operator == "NEQ", ~eq)


def value_satisfies(value: Column, operator: Column, bound: Column) -> Column:
    """satisfies() on parsed values: null across unit families; of booleans, EQ, LTE and GTE mean equal, all others different."""
    same = value["boolean"] == bound["boolean"]
    numbers = F.when(same_family(value["unit"], bound["unit"]), satisfies(value["number"], operator, bound["number"]))
    return F.when(same.isNotNull() & operator.isNotNull(), F.when(operator.isin("EQ", "LTE", "GTE"), same).otherwise(~same)).otherwise(numbers)


def values_conflict(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(relative_delta(a, b)) > tolerance


def any_conflict(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """values_conflict() on parsed values: numbers of one family beyond the tolerance, booleans that differ, else texts, trimmed and in lower case."""
    numeric = a["number"].isNotNull() & b["number"].isNotNull()
    words = lambda v: F.lower(F.trim(F.coalesce(v["text"], v["raw"])))
    return F.when(numeric & same_family(a["unit"], b["unit"]), F.coalesce(values_conflict(a["number"], b["number"], tolerance), F.lit(False))).when(
        a["boolean"].isNotNull() & b["boolean"].isNotNull(), a["boolean"] != b["boolean"]).otherwise(words(a) != words(b))


def change(old: Column, new: Column, tolerance: float = TOLERANCE) -> Column:
    """struct(kind, delta, magnitude, material) of a belief's parsed value against the one before (null: it is new)."""
    delta = relative_delta(old["number"], new["number"])
    numeric = old["number"].isNotNull() & new["number"].isNotNull()
    flip = old["boolean"].isNotNull() & new["boolean"].isNotNull()
    same_text = F.lower(F.trim(F.coalesce(old["text"], old["raw"]))) == F.lower(F.trim(F.coalesce(new["text"], new["raw"])))
    moved = F.coalesce(F.abs(delta) > tolerance, F.lit(False))
    kind = F.when(old.isNull(), "NEW").when(numeric & ~same_family(old["unit"], new["unit"]), "UNIT_CHANGED").when(numeric, F.when(~moved, "UNCHANGED").when(delta > 0, "INCREASED").otherwise("DECREASED")).when(
        flip, F.when(old["boolean"] != new["boolean"], "FLIPPED").otherwise("UNCHANGED")).when(same_text, "UNCHANGED").otherwise("TEXT_REFINED")
    size = F.when(kind == "NEW", 0.6).when(kind == "UNIT_CHANGED", 0.8).when(kind == "FLIPPED", 1.0).when(kind == "UNCHANGED", 0.0).when(kind == "TEXT_REFINED", 0.5).otherwise(magnitude(delta))
    return F.struct(kind.alias("kind"), F.when(kind.isin("INCREASED", "DECREASED"), F.round(delta, 4)).alias("delta"), F.round(size, 4).alias("magnitude"), (~kind.isin("UNCHANGED", "TEXT_REFINED")).alias("material"))


def specificity(value: Column, bounded: Column, triple: Column) -> Column:
    part = lambda ok, w: F.when(ok, w).otherwise(0.0)
    return F.least(part(value.isNotNull(), 0.35) + part(value["number"].isNotNull(), 0.25) + part(value["unit"].isNotNull(), 0.15) + part(bounded, 0.15) + part(triple, 0.10), F.lit(1.0))


def temporal_validity(valid_from: Column, valid_until: Column, now: Column) -> Column:
    """0 outside the interval, 1 within a closed one, 0.9 with a start only, else 0.6."""
    out = (valid_from > now) | (valid_until < now)
    return F.when(F.coalesce(out, valid_until < now, valid_from > now, F.lit(False)), 0.0).when(valid_from.isNotNull() & valid_until.isNotNull(), 1.0).when(valid_from.isNotNull(), 0.9).otherwise(0.6)


def magnitude(delta: Column) -> Column:
    """Saturating size of a change, a / (a + 0.35)."""
    a = F.abs(delta)
    return a / (a + 0.35)


def recency(observed: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(observed.cast("timestamp"))) / 86_400e6)
    return F.pow(F.lit(0.5), days / HALF_LIFE)


def corroboration(n: Column) -> Column:
    return 1 - F.exp(-0.9 * n)


def credibility(authority: Column, recent: Column, confidence: Column, support: Column, specific: Column, temporal: Column) -> Column:
    parts = ((0.26, F.coalesce(authority, F.lit(0.5))), (0.22, recent), (0.18, confidence), (0.14, support), (0.10, specific), (0.10, temporal))
    return F.round(F.round(sum((w * F.round(c, 4) for w, c in parts), F.lit(0.0)), 8), 4)  # 8 first: a sum's last bit decides no tie


def severity(base: float, criticality: Column, delta: Column) -> Column:
    size = F.coalesce(F.least(F.abs(delta), F.lit(1.0)), F.lit(0.5))
    return F.round(F.least(F.lit(1.0), base * (0.55 + 0.45 * criticality) * (0.6 + 0.4 * size)), 4)
