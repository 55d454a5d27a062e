"""Text as Column expressions: fingerprints, slugs, names, markup, sentences, similarity."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-1 over the trimmed lower-case parts, each closed by a unit separator."""
    clean = [F.concat(F.lower(F.regexp_replace(F.coalesce(p, F.lit("")), r"^\s+|\s+$", "")), F.lit("\x1f")) for p in parts]
    return F.substring(F.sha1(F.concat(*clean)), 1, 16)


def slugify(text: Column, most: int = 60) -> Column:
    """Words in lower case joined by hyphens, signs left out, `most` characters at most; 'untitled' where nothing is left."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\w\s-]", "")))
    slug = F.regexp_replace(F.substring(F.regexp_replace(plain, r"(?U)[\s_-]+", "-"), 1, most), "^-+|-+$", "")
    return F.when(text.isNotNull(), F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled")))


#: Words that name no company.
LEGAL = "ltd limited inc incorporated llc plc gmbh corp corporation co company pvt private the of and".split()


def normalise(name: Column) -> Column:
    """Lower case, signs and legal forms to spaces, single spaces; letters of any script stay."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"(?U)\b({'|'.join(LEGAL)})\b", " "), r"(?U)\s+", " "))


#: Character references that are undone by name; those by number are undone by rule.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "deg": "°", "euro": "€", "pound": "£", "eacute": "é", "egrave": "è", "agrave": "à", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "ccedil": "ç"}


def unescape(text: Column) -> Column:
    """Character references undone, the ampersand's last; unknown names stay."""
    def char(m: Column) -> Column:
        code = F.regexp_extract(m, r"^&#[xX]?([0-9a-fA-F]+);", 1)
        at = F.when(m.rlike("^&#[xX]"), F.conv(code, 16, 10)).otherwise(code).try_cast("int")
        own = F.when((at > 0) & (at < 0x110000) & ~at.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32"))
        return F.coalesce(own, F.lit("\ufffd"))

    out = text
    for name, c in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    # numbered ones: the texts between them, and the characters, in turn
    number = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"

    def numbered(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"({number})"), F.lit(1))
        put = F.transform(F.split(t, number), lambda x, i: F.concat(x, F.when(i < F.size(found), char(F.get(found, i))).otherwise("")))
        return F.when(F.contains(t, F.lit("&#")), F.array_join(put, "")).otherwise(t)

    return F.replace(F.transform(F.array(out), numbered)[0], F.lit("&amp;"), F.lit("&"))  # in an array, so that the text is worked out once


def strip_html(page: Column) -> Column:
    """Script and style dropped, headings marked with # on lines of their own, block tags to line ends, other tags to spaces, references undone."""
    out = F.regexp_replace(page, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(?:p|div|li|tr|br)[^>]*>", "\n"), r"<[^>]+>", " ")
    return F.regexp_replace(unescape(out), r"\n{3,}", "\n\n")


def title(name: Column, text: Column) -> Column:
    """The first heading of level one, 120 characters of it at most, else the file's name in title case without its suffix."""
    head = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^#\s+(.+)$", 1))
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.substring(F.coalesce(F.nullif(head, F.lit("")), F.initcap(F.regexp_replace(stem, "[-_]+", " "))), 1, 120)


def sentences(text: Column) -> Column:
    """Sentences of more than eight characters: headings and rules dropped, wrapped lines joined, split after . ! ? ; before a capital or digit."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\f\x0b\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.when(x.rlike(r"^\s*#{1,6}\s|^\s*[-*=_]{3,}\s*$|^\s*$"), F.lit("\n")).otherwise(F.trim(x)))
    paragraphs = F.split(F.array_join(lines, " "), r" ?\n ?")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?;])\s+(?=[A-Z0-9])")))
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.filter(clean, lambda s: F.length(s) > 8)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the two is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's share of matching blocks, which no built-in function gives."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def lexical_similarity(a: Column, b: Column) -> Column:
    """1 for equal normalised names; else the larger of 0.55 sequence ratio + 0.45 Jaccard, and 0.85 where one's words are among the other's."""
    x, y = normalise(a), normalise(b)
    s, t = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    common = F.size(F.array_intersect(s, t))
    within = F.when((common == F.size(s)) | (common == F.size(t)), 0.85).otherwise(0.0)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.round(F.greatest(0.55 * sequence_ratio(x, y) + 0.45 * jaccard(s, t), within), 4))


#: Kinds of entity that are compatible.
FAMILIES = ["organization organisation supplier vendor company", "component system product platform", "project programme program deployment", "regulation standard policy"]


def type_agreement(a: Column, b: Column) -> Column:
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    kin = F.lit(False)
    for f in FAMILIES:
        kin = kin | (x.isin(*f.split()) & y.isin(*f.split()))
    return F.when((x == "") | (y == ""), 0.5).when(x == y, 1.0).when(kin, 0.85).otherwise(0.15)


def context_overlap(neighbours: Column, context: Column) -> Column:
    """Shared members of two arrays of ids, by the smaller of 4 and the context's size; 0 where one is empty."""
    n = F.size(F.array_intersect(neighbours, F.array_distinct(context)))
    return F.round(F.least(F.coalesce(F.try_divide(n, F.least(F.size(F.array_distinct(context)), F.lit(4))), F.lit(0.0)), F.lit(1.0)), 4)


#: Words in a source's name or opening that tell its authority; the first row that fits holds.
AUTHORITY = [
    ("regulation|directive|standard|unece|iso|iec|statute|law|compliance", 0.95),
    ("contract|agreement|certification|audit", 0.88),
    ("report|test|measurement|telemetry|analysis", 0.80),
    ("spec|specification|requirement|design", 0.75),
    ("minutes|memo|email|note|draft|slack", 0.55),
]
#: Forms of a date, each with its pattern.
DATES = [(r"^\d{4}-\d\d?-\d\d?$", "y-M-d"), (r"^\d{4}/\d\d?/\d\d?$", "y/M/d"), (r"^\d\d?-\d\d?-\d{4}$", "d-M-y"), (r"^\d\d?/\d\d?/\d{4}$", "d/M/y"), (r"^\d{4}-\d\d?$", "y-M"), (r"^\d{4}$", "y")]


def authority(name: Column, text: Column) -> Column:
    """Authority of a source by its name and the 400 characters in which it presents itself; 0.65 where nothing fits."""
    probe = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 400)))
    out = F.lit(0.65)
    for pattern, score in reversed(AUTHORITY):
        out = F.when(probe.rlike(pattern), score).otherwise(out)
    return out


def parse_date(raw: Column) -> Column:
    """UTC time of a text in any form of DATES or in ISO 8601; null for anything else."""
    t = F.trim(raw)
    return F.coalesce(*(F.when(t.rlike(form), F.try_to_timestamp(t, F.lit(pattern))) for form, pattern in DATES), F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]"), t.try_cast("timestamp")))
