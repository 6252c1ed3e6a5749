"""Normalisation and similarity as column expressions.

Every normaliser keeps the raw value, gives a canonical value and flags;
nothing is repaired.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the tax number's control digits.
W10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
W11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
W12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
#: Section letters of the activity classes, by first and last class.
SECTIONS = [
    ("A", 1, 3), ("B", 5, 9), ("C", 10, 33), ("D", 35, 35), ("E", 36, 39), ("F", 41, 43), ("G", 45, 47), ("H", 49, 53), ("I", 55, 56), ("J", 58, 63), ("K", 64, 66),
    ("L", 68, 68), ("M", 69, 75), ("N", 77, 82), ("O", 84, 84), ("P", 85, 85), ("Q", 86, 88), ("R", 90, 93), ("S", 94, 96), ("T", 97, 98), ("U", 99, 99),
]
#: Similarity of two codes by the deepest level they share.
LEVEL_SCORES = [("kind", 0.7), ("subgroup", 0.55), ("group", 0.4), ("subclass", 0.25), ("class", 0.1)]


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _control(inn: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.lit(w) * F.substring(inn, i + 1, 1).try_cast("int") for i, w in enumerate(weights)), F.lit(0))
    return total % 11 % 10 == F.substring(inn, len(weights) + 1, 1).try_cast("int")


def inn(raw: Column) -> Column:
    """Tax number: value, kind of holder, region and flag."""
    s = _stripped(raw)
    shape = s.rlike("^([0-9]{10}|[0-9]{12})$")
    ok = F.when(F.length(s) == 10, _control(s, W10)).otherwise(_control(s, W11) & _control(s, W12))
    flag = F.when(s == "", "MISSING_INN").when(~shape, "INVALID_INN_FORMAT").when(~ok, "INVALID_INN_CHECKSUM")
    holder = F.when(~shape, "unknown").when(F.length(s) == 10, "legal_entity").otherwise("individual_entrepreneur")
    return F.struct(F.when(s != "", s).alias("inn"), holder.alias("entity_type"), F.when(shape, F.substring(s, 1, 2)).alias("region"), flag.alias("flag"))


def kpp(raw: Column) -> Column:
    s = _stripped(raw)
    return F.struct(F.when(s != "", s).alias("kpp"), F.when(s == "", "MISSING_KPP").when(~s.rlike("^[0-9]{4}[0-9A-Z]{2}[0-9]{3}$"), "INVALID_KPP_FORMAT").alias("flag"))


def section(two_digits: Column) -> Column:
    n, out = two_digits.try_cast("int"), F.lit(None).cast("string")
    for letter, lo, hi in SECTIONS:
        out = F.when(n.between(lo, hi), letter).otherwise(out)
    return out


def okpd2(raw: Column) -> Column:
    """Category code with its levels; a malformed code has none, only a flag."""
    s = _stripped(raw)
    sec = section(F.substring(s, 1, 2))
    seg = F.split(s, r"\.", -1)
    depth = F.size(seg)
    # two digits a level; the last of two or three levels may have one, a fourth up to three
    most = lambda i: F.when(i == 3, 3).otherwise(2)
    least = lambda i: F.when((i == depth - 1) & (i > 0), 1).otherwise(2)
    levels = F.transform(seg, lambda x, i: x.rlike("^[0-9]+$") & F.length(x).between(least(i), most(i)))
    good = (depth <= 4) & F.forall(levels, lambda x: x) & sec.isNotNull()
    second, third = F.get(seg, 1), F.get(seg, 2)
    group = F.when((depth >= 2) & (F.length(second) == 2), F.concat_ws(".", seg[0], second))
    of = lambda c: F.when(good, c)
    return F.struct(
        of(s).alias("code"), of(depth).alias("depth"), of(sec).alias("section"), of(seg[0]).alias("class"),
        of(F.when(depth >= 2, F.concat(seg[0], F.lit("."), F.substring(second, 1, 1)))).alias("subclass"), of(group).alias("group"),
        of(F.when(depth >= 3, F.concat(group, F.lit("."), F.substring(third, 1, 1)))).alias("subgroup"),
        of(F.when((depth >= 3) & (F.length(third) == 2), F.concat(group, F.lit("."), third))).alias("kind"),
        F.when(s == "", "MISSING_OKPD2").when(~good, "INVALID_OKPD2").alias("flag"),
    )


def okpd2_path(o: Column) -> Column:
    """A category struct with its levels in order, and the place of the
    deepest level it denotes itself (none for a whole code of four parts)."""
    path = F.array(*[o[level] for level, _ in reversed(LEVEL_SCORES)])
    deepest = F.lit(None).cast("int")
    for i in range(len(LEVEL_SCORES)):
        deepest = F.when(path[i].isNotNull(), i).otherwise(deepest)
    whole = F.size(F.split(o["code"], r"\.")) == 4
    return F.struct(o["code"].alias("code"), path.alias("path"), F.when(~whole, deepest).alias("deepest"))


def path_similarity(q: Column, h: Column) -> Column:
    """Similarity of two categories as ``okpd2_path`` gives them."""
    same = lambda i: F.coalesce(F.get(q["path"], i) == F.get(h["path"], i), F.lit(False))
    out = F.when(same(q["deepest"]) | same(h["deepest"]), 0.8)
    for i, (_, score) in enumerate(LEVEL_SCORES):
        out = out.when(same(F.lit(len(LEVEL_SCORES) - 1 - i)), score)
    return F.when(q["code"].isNull() | h["code"].isNull(), 0.0).when(q["code"] == h["code"], 1.0).otherwise(out.otherwise(0.0))


def okpd2_similarity(q: Column, h: Column) -> Column:
    """1 for the same code, 0.8 where one lies in the other's branch, then by
    the deepest common level; 0 for unrelated or missing codes."""
    return path_similarity(okpd2_path(q), okpd2_path(h))


def price(raw: Column) -> Column:
    s = _stripped(raw)
    good = s.rlike(r"^[0-9]{1,15}(\.[0-9]{1,4})?$")
    value = F.when(good, s.try_cast("decimal(19,4)"))
    return F.struct(value.alias("value"), F.when(s == "", "MISSING_START_PRICE").when(value == 0, "ZERO_START_PRICE").alias("flag"), (~good & (s != "")).alias("structural"))


def iso_date(raw: Column) -> Column:
    """A strict calendar date, else null (the row is for quarantine)."""
    s = _stripped(raw)
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s.try_cast("date"))


def strict_bool(raw: Column) -> Column:
    s = _stripped(raw)
    return F.when(s == "true", True).when(s == "false", False)


def platform(raw: Column) -> Column:
    s = _stripped(raw)
    return F.when(s == "АИС ГЗ", "AIS_GZ").when(s == "ЭМ", "EM")


def comparison_key(raw: Column) -> Column:
    lower = F.translate(F.lower(F.coalesce(raw, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(lower, r"(?U)\W+", " "))


def name_variant(name: Column, subject: Column) -> Column:
    """A procedure name only where it says something else than the subject."""
    s = _stripped(name)
    return F.when((s != "") & (comparison_key(s) != comparison_key(subject)), s)


def type_marker(text: Column) -> Column:
    """``тип`` and a number of up to three digits, in one token or in two."""
    joined = F.regexp_replace(F.concat_ws(" ", F.lit(""), text, F.lit("")), r"(?U)[^\w]+", "  ")
    found = F.regexp_extract(joined, r" тип {0,2}([0-9]{1,3}) ", 1)
    return F.when(found != "", F.concat(F.lit("тип "), found))


def code_relation(a: Column, b: Column) -> Column:
    """How two category codes meet: 3 the same, 2 in one group, 1 in one class, 0 not at all."""
    first, second = F.split(a, r"\."), F.split(b, r"\.")
    group = (F.size(first) >= 2) & (F.size(second) >= 2) & (first[0] == second[0]) & (F.get(first, F.lit(1)) == F.get(second, F.lit(1)))
    return F.when(a == b, 3).when(F.coalesce(group, F.lit(False)), 2).when(first[0] == second[0], 1).otherwise(0)


def alignment(best: Column) -> Column:
    """What the best relation of a given code to the suggested ones says."""
    return F.when(best >= 2, "ALIGNED").when(best == 1, "UNCERTAIN").when(best == 0, "MISMATCH")


def numeric_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t.rlike(r"\d"))


def tech_tokens(text: Column, least: int = 5) -> Column:
    """Distinct tokens with letters and digits, in order."""
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), " "), lambda t: F.regexp_replace(t, r'^["%]+|["%]+$', ""))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= least) & t.rlike(r"(?U)\p{L}") & t.rlike(r"\d")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def saturation(x: Column, scale: float) -> Column:
    return 1 - F.exp(-x / scale) if scale > 0 else F.lit(0.0)


def recency(days: Column, half_life: float = 365.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def idf(documents: Column, df: Column) -> Column:
    return F.log((documents + 1) / (df + 1)) + 1


def calibrated(cosine: Column, floor: float = 0.82, ceiling: float = 0.95) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - floor) / (ceiling - floor)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID in SQL: the first 128 bits of SHA-1 of namespace and
    name, with the version and variant bits set."""
    space = uuid.UUID(namespace).hex
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def phone(raw: Column) -> Column:
    """Eleven digits that begin with 7, or null."""
    d = F.regexp_replace(raw, r"\D", "")
    return F.when((F.length(d) == 11) & d.rlike("^[78]"), F.concat(F.lit("7"), F.substring(d, 2, 10))).when((F.length(d) == 10) & d.rlike("^[3489]"), F.concat(F.lit("7"), d))


def host(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def registrable_domain(h: Column) -> Column:
    """The last two labels, three below regional second-level zones."""
    parts = F.split(F.lower(h), r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ".")
    zones = ["spb.ru", "msk.ru", "com.ru", "net.ru", "org.ru", "pp.ru", "co.uk"]
    return F.when((F.size(parts) >= 3) & two.isin(zones), three).otherwise(two)


def like_pattern(needle: Column) -> Column:
    """A LIKE pattern for texts that contain ``needle``; its wildcards are escaped."""
    return F.concat(F.lit("%"), F.regexp_replace(needle, r"([\\%_])", r"\\$1"), F.lit("%"))


def search_id(*fields: Column) -> Column:
    """A stateless id of a search: its request as base64 JSON."""
    return F.base64(F.encode(F.to_json(F.struct(*fields)), "UTF-8"))
