"""From text to rows: each sentence becomes a requirement, decision, event, risk, claim or relationship by fixed cues, in that order."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences

#: Comparators, cues, predicates and kinds; of each list the first that fits holds.
COMPARATORS = [
    ("must not exceed|shall not exceed|may not exceed|not exceed|no more than|at most|up to a maximum of|capped at", "LTE"),
    ("must remain below|must stay below|must be below|must be under|must be less than|less than|below|under|beneath", "LT"),
    ("at least|no less than|not less than|minimum of|no lower than", "GTE"),
    ("must exceed|greater than|more than|above|over", "GT"),
    ("must equal|must be exactly|exactly", "EQ"),
]
REQUIREMENT = r"\b(must|shall|required to|requirement|mandat\w*|obliged|may not|is limited to|limit of|budget|not exceed)\b"
DECISION = r"\b(decision|we (?:will|have|shall)|decided|selected|chose|chosen|approved|opted|go(?:ing)? with|adopt(?:ed)?|award(?:ed)? to)\b"
EVENT = r"\b(published|issued|announced|updated|revised|amended|deprecat\w*|effective (?:from|as of)|withdrawn|recalled|reduced from|increased from|came into force|takes effect|superseded?)\b"
RISK = r"\b(risk|hazard|may fail|could fail|could result in|threatens?|exposure|vulnerab\w*|jeopardis\w*|jeopardiz\w*|danger)\b"
OBSERVATION = r"\b(measured|observed|recorded|logged|telemetry|test(?:ing|ed)? show\w*|reported at|sampled|monitored)\b"
ASSUMPTION = r"\b(assum\w+|presum\w+|expected to|anticipat\w+|baseline of)\b"
PREDICATES = [
    (r"operating temperature|temperature limit|temperature threshold|thermal limit|max\w* temperature|cell temperature", "max operating temperature"),
    (r"charg\w+ (?:time|duration)", "charging time"),
    (r"charg\w+ (?:power|rate)", "charging power"),
    (r"\b(?:production |monthly |manufacturing |supply )?capacity\b|throughput per month|output per month", "capacity"),
    (r"latency|response time|round[- ]trip time", "latency"),
    (r"throughput|transactions per second|requests per second", "throughput"),
    (r"\b(?:unit |total |capital |operating )?cost\b|price|budget|expenditure|capex|opex", "cost"),
    (r"\brange\b|driving range|distance per charge", "range"),
    (r"availability|uptime|service level", "availability"),
    (r"lead time|delivery time|turnaround", "lead time"),
    (r"energy density", "energy density"),
    (r"cycle life|service life|lifetime", "cycle life"),
    (r"weight|mass", "mass"),
    (r"utilisation|utilization|load factor", "utilisation"),
    (r"fleet size|number of vehicles|vehicle count", "fleet size"),
]
UNIT_PREDICATES = [
    (r"^(°|deg|degree)|^[CF]$", "max operating temperature"),
    (r"^(ms|msec|sec|second|min|minute|hour|hr|day|week)", "duration"),
    (r"^(tps|rps|qps)$", "throughput"),
    (r"^(km|cm|mm)$", "range"),
    (r"^(kwh|kw|mwh|mw|wh)$", "power"),
    (r"^(kg|tonne)", "mass"),
    (r"^(unit|piece|vehicle|cell|station)", "capacity"),
    (r"^%$", "percentage"),
]
STARTS = "The This That These Those A An It We They However Therefore Because Since If When While As After Before Following Under For In On At All Each Any Both Its Their Our There Per".split()
NO_HEAD = "the a an of for to is are was were be must shall will has have had its their this that at in on by with and or not per system we it each any all may can should".split()
VALUE = (
    r"(?i)(?<![A-Za-z0-9-])([₹$€])?\s*(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:\s*(lakhs?|lac|crores?|million|billion|thousand|mn|bn|k)\b)?"
    r"(?:\s*(%|°\s?[CF]|deg\s?[CF]|degrees? (?:celsius|centigrade|fahrenheit)|[CF]\b|kWh|kW|MWh|MW|Wh|ms\b|msec\b|secs?\b|seconds?\b|minutes?\b|mins?\b|"
    r"hours?\b|hrs?\b|days?\b|weeks?\b|months?\b|km\b|cm\b|mm\b|kg\b|tonnes?\b|TPS\b|rps\b|qps\b|V\b|Ah\b|units?(?:\s*(?:/|per)\s*\w+)?|vehicles?|users?|cells?|stations?|pieces?))?"
)
ENTITY = r"\b((?:[A-Z][a-zA-Z]*(?:[- ][A-Z0-9][a-zA-Z0-9-]*)+|[A-Z]{2,}(?:[- ]?\d+(?:\.\d+)?)?|[A-Z][a-zA-Z]+-\d+|[A-Z]\d+))\b"
RELATIONS = [
    (r"\bdepends? on\b|\brelies on\b|\bcontingent on\b", "DEPENDS_ON"), (r"\brequires?\b|\bneeds?\b|\bprerequisite\b", "REQUIRES"),
    (r"\bcauses?\b|\bleads? to\b|\bresults? in\b|\btriggers?\b", "CAUSES"), (r"\baffects?\b|\bimpacts?\b|\binfluences?\b", "AFFECTS"),
    (r"\bsupersedes?\b|\breplaces?\b", "SUPERSEDES"), (r"\bimplements?\b|\bsatisfies\b|\brealis\w+\b", "IMPLEMENTS"),
    (r"\bconstrains?\b|\blimits?\b|\bgoverns?\b", "CONSTRAINS"), (r"\bcontradicts?\b|\bconflicts? with\b|\bdisagrees with\b", "CONTRADICTS"),
    (r"\bsupports?\b|\bcorroborates?\b|\bconfirms?\b", "SUPPORTS"), (r"\bowned by\b|\bmanaged by\b|\boperated by\b", "OWNED_BY"),
]
KINDS = [
    (r"\b(ltd|inc|gmbh|corp|corporation|supplier|vendor|partners?)\b", "Organization"),
    (r"\b(unece|iso|iec|en|astm|regulation|directive|standard)\b", "Regulation"),
    (r"\b(pack|module|battery|motor|sensor|controller|unit|station)\b", "Component"),
    (r"\b(fleet|programme|program|project|phase|deployment)\b", "Project"),
    (r"\b(architecture|system|platform|service|api)\b", "System"),
]


def needed(pattern: str) -> list[str]:
    """Texts in lower case of which every match of a pattern, whatever the case, holds at least one; none where the pattern has no such texts."""

    def of(seq) -> list[str]:
        ways, run = [], ""
        for op, arg in [*seq, (None, None)]:
            if str(op) == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            ways, run = [*ways, [run]] if run else ways, ""
            if str(op) == "SUBPATTERN":
                ways.append(of(arg[3]))
            elif str(op) == "BRANCH":
                each = [of(x) for x in arg[1]]
                ways.append([t for x in each for t in x] if all(each) else [])
            elif str(op) == "MAX_REPEAT" and arg[0]:
                ways.append(of(arg[2]))
        return max(ways, key=lambda w: min(map(len, w), default=0), default=[])

    return list(dict.fromkeys(of(re._parser.parse(pattern))))


def says(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern fits a text, whatever the case. low: the text in lower case, in which the pattern's needed() texts are looked for first, as that takes
    a small part of the time."""
    some, fits = needed(pattern), text.rlike("(?i)" + pattern)
    return F.when(F.exists(F.array(*map(F.lit, some)), lambda x: F.contains(low, x)), fits).otherwise(F.lit(False)) if some else fits


def _first(rules: list[tuple[str, str]], text: Column, flags: str = "(?i)", low: Column | None = None) -> Column:
    return F.coalesce(*(F.when(text.rlike(flags + p) if low is None else says(text, low, p), F.lit(v)) for p, v in rules))


def entity_kind(name: Column) -> Column:
    return F.coalesce(_first(KINDS, F.lower(name), ""), F.lit("Concept"))


def find_entities(text: Column, known: list[str] | None = None) -> Column:
    """Known names that occur, then proper nouns, each once whatever its case; `known` is a bounded list of names, in order."""
    said = F.filter(F.array(*map(F.lit, known)), lambda k: F.regexp_like(text, F.concat(F.lit(r"(?i)\b\Q"), k, F.lit(r"\E\b")))) if known else F.array().cast("array<string>")
    nouns = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), lambda x: F.trim(x))
    nouns = F.filter(nouns, lambda x: (F.length(x) >= 3) & ~(F.substring_index(x, " ", 1).isin(*STARTS) & (F.size(F.split(x, r"\s+")) < 3)))

    def once(a: Column) -> Column:
        low = F.transform(a, F.lower)
        return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    return F.transform(F.array(F.concat(said, nouns)), once)[0]


def value_in(text: Column) -> Column:
    """struct(value, unit) of the first number with a unit, currency or magnitude; null if there is none."""
    text = F.when(text.rlike("[0-9]"), text)  # no number without a digit
    groups = [F.regexp_extract_all(text, F.lit(VALUE), F.lit(i)) for i in range(1, 5)]
    found = F.filter(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("cur", "num", "mag", "unit"), strict=True))), lambda m: (m["unit"] != "") | (m["cur"] != "") | (m["mag"] != ""))
    return F.get(F.transform(F.slice(found, 1, 1), lambda m: F.struct(F.trim(F.concat_ws(" ", m["num"], F.nullif(m["mag"], F.lit("")))).alias("value"), F.coalesce(F.nullif(F.trim(m["unit"]), F.lit("")), F.nullif(m["cur"], F.lit(""))).alias("unit"))), F.lit(0))


def predicate_of(sentence: Column, value: Column, before: Column, low: Column | None = None) -> Column:
    """By the sentence's words (low: the sentence in lower case), else by the unit, else the last three content words before the value."""
    words = F.filter(F.regexp_extract_all(F.lower(before), F.lit("([a-z][a-z-]+)"), F.lit(1)), lambda w: ~w.isin(*NO_HEAD))
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3), " ")
    money = F.when(F.concat(F.coalesce(value["unit"], F.lit("")), value["value"]).rlike("[₹$€]"), "cost")
    return F.coalesce(_first(PREDICATES, sentence, low=low), _first(UNIT_PREDICATES, F.trim(value["unit"])), money, F.nullif(tail, F.lit("")), F.lit("value"))


def extract(chunks: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Rows (id, n, sentence, record, kind, subject, predicate, operator, value, unit, confidence, severity, rationale, related) of chunks (id, text, default_subject).

    One record a sentence (n, from 1): constraint, decision, event, risk, claim or relationship; an event that says from what to
    what is a claim besides. A sentence without a subject has that of one at most two sentences before, else the default one, with 0.12 less
    confidence. Sentences that fit nothing give no row; null texts none. The work is in reading the texts, not in their bytes, so they are dealt to as many
    parts as a shuffle has, however few files they come from."""
    dealt = chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    s = dealt.select("id", "default_subject", F.posexplode(sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n") + 1)
    s = s.withColumns({"named": find_entities(F.col("sentence"), known), "low": F.lower("sentence")})
    back = Window.partitionBy("id").orderBy("n").rowsBetween(-2, 0)
    carried = F.last(F.get("named", F.lit(0)), ignorenulls=True).over(back)
    s = s.withColumn("carried", carried).withColumn("subject", F.coalesce("carried", "default_subject"))
    less = F.when(F.col("carried").isNull() & F.col("subject").isNotNull(), 0.12).otherwise(0.0)
    t, low = F.col("sentence"), F.col("low")
    part = lambda i: F.coalesce(*(F.when(F.col("operator") == o, F.regexp_extract(t, rf"(?is)^(.*?)(?:{p})(.*)$", i)) for p, o in COMPARATORS))
    s = s.withColumn("operator", _first(COMPARATORS, t, low=low)).withColumns({"left": part(1), "right": part(2)}).withColumn("value", value_in(F.coalesce("right", "sentence")))
    cue = lambda p: says(t, low, p)
    has_subject, has_value = F.col("subject").isNotNull(), F.col("value").isNotNull()
    shift = r"(?:reduced|lowered|raised|increased|changed|revised)\s+from\s+([^,;]+?)\s+to\s+([^,;.]+)"
    pair = F.when(cue(shift), F.regexp_extract(t, "(?i)" + shift, 2))
    s = s.withColumn("new", value_in(pair)).withColumn("relation", reduce(lambda later, r: F.when(F.when(cue(r[0]), _ends(t, r[0], known).isNotNull()).otherwise(F.lit(False)), F.struct(F.lit(r[1]).alias("type"), _ends(t, r[0], known).alias("ends"))).otherwise(later), reversed(RELATIONS), F.lit(None).cast("struct<type:string,ends:struct<source:string,target:string>>")))
    null, text = F.lit(None).cast("string"), F.coalesce("subject", F.lit(""))

    def row(record: str, kind: Column, confidence: Column, subject: Column = text, predicate: Column = null, operator: Column = null, value: Column | None = None, severity: Column | None = None, rationale: Column = null, related: Column = null) -> Column:
        v = F.lit(None).cast("struct<value:string,unit:string>") if value is None else value
        return F.struct(F.lit(record).alias("record"), kind.alias("kind"), subject.alias("subject"), predicate.alias("predicate"), operator.alias("operator"), v["value"].alias("value"), v["unit"].alias("unit"), F.round(confidence, 4).alias("confidence"), (F.lit(None).cast("double") if severity is None else severity).alias("severity"), rationale.alias("rationale"), related.alias("related"))

    v, new, nothing = F.col("value"), F.col("new"), F.lit("")
    because = F.regexp_replace(F.regexp_extract(t, r"(?i)\b(?:because|since|as|due to|owing to)\b(.+)", 1), r"^[ .]+|[ .]+$", "")
    before = F.when(F.contains(t, v["value"]), F.call_function("substring_index", t, v["value"], F.lit(1))).otherwise(t)
    constraint = row("constraint", F.when(t.rlike(r"(?i)\b(must|shall)\b"), "Requirement").otherwise("Constraint"), 0.72 - less, F.col("subject"), predicate_of(t, v, F.col("left"), low), F.col("operator"), v)
    decision = row("decision", F.lit("Decision"), F.lit(0.62), rationale=because)
    event = row("event", F.lit("Event"), F.lit(0.65), related=F.array_join(F.slice("named", 1, 4), "|"))
    changed = row("claim", F.lit("Claim"), F.lit(0.68), F.col("subject"), predicate_of(t, new, t, low), value=new)
    risk = row("risk", F.lit("Risk"), F.lit(0.55), severity=F.when(t.rlike(r"(?i)\bcritical|severe|major\b"), 0.6).otherwise(0.45))
    kind = F.when(cue(OBSERVATION), "Observation").when(cue(ASSUMPTION), "Assumption").otherwise("Claim")
    claim = row("claim", kind, F.when(cue(OBSERVATION), 0.70).otherwise(0.65) - less, F.col("subject"), predicate_of(t, v, before, low), value=v)
    relation = row("relationship", F.col("relation.type"), F.lit(0.6), F.col("relation.ends.source"), related=F.col("relation.ends.target"))
    rows = F.when(F.col("operator").isNotNull() & has_value & cue(REQUIREMENT) & has_subject, F.array(constraint)).when(cue(DECISION), F.array(decision)).when(
        cue(EVENT), F.when(new.isNotNull() & has_subject, F.array(event, changed)).otherwise(F.array(event))).when(cue(RISK), F.array(risk)).when(has_value & has_subject, F.array(claim)).when(F.col("relation").isNotNull(), F.array(relation))
    return s.select("id", "n", "sentence", F.explode(rows).alias("r")).select("id", "n", "sentence", "r.*")


def _ends(text: Column, pattern: str, known: list[str] | None) -> Column:
    """struct(source, target): the nearest entities on both sides of a relation's first words; null if one is missing."""
    side = lambda i: find_entities(F.regexp_extract(text, rf"(?is)^(.*?)(?:{pattern})(.*)$", i), known)
    source, target = F.try_element_at(side(1), F.lit(-1)), F.get(side(2), F.lit(0))
    return F.when(source.isNotNull() & target.isNotNull(), F.struct(source.alias("source"), target.alias("target")))


def principal_subject(records: DataFrame) -> DataFrame:
    """(id, subject): the commonest subject of a text's claims and constraints; of equals the first said."""
    own = records.where(F.col("record").isin("claim", "constraint") & F.col("subject").isNotNull())
    n = own.groupBy("id", "subject").agg(F.count("*").alias("n"), F.min("n").alias("first"))
    return n.groupBy("id").agg(F.max_by("subject", F.struct("n", -F.col("first"))).alias("subject"))
