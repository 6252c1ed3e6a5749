"""Whether a site is a supplier's own: identity signals on its pages, their grade, and guesses of host names.

Every page is judged by itself and a site is the union of its pages' signals,
so a page's text never leaves its task.  Numbers are found once, with the text
around them: a tax number inside a warning about impostors says whose site it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import occurrences

WARNED_BEFORE, WARNED_AFTER, HOUSE_WITHIN, OTHERS = 300, 500, 40, 3

#: Words of a warning about impostors, legal forms, and how a place, a street and a house are written.
WARNING = [
    "мошенни", "злоумышленн", r"от имени[^.]{0,80}(?:не является|не являются|не имеет|не связан)", r"не является[^.]{0,60}(?:сотрудник|представител|сайт|организатор)", "не имеет отношения", "не принадлеж",
    "поддельн", "фальшив", "фейков", "остерегайтесь", "осторожно", "убедительно просим", "с особым вниманием",
]
LEGAL_FORMS = [
    "общество с ограниченной ответственностью", "акционерное общество", "публичное акционерное общество", "закрытое акционерное общество", "открытое акционерное общество", "непубличное акционерное общество",
    "федеральное государственное (?:казенное|бюджетное|унитарное)? ?(?:учреждение|предприятие)", "государственное (?:бюджетное|казенное|автономное)? ?учреждение", "индивидуальный предприниматель",
    "ооо", "ао", "пао", "зао", "оао", "нао", "фгку", "фгуп", "гбу", "гку", "ип",
]
PLACES = "г город д с пос пгт рп п ст-ца х".split()
STREETS = "ул улица пр-кт проспект пр пер переулок ш шоссе наб набережная б-р бульвар пл площадь проезд тракт мкр".split()
HOUSES = "д дом зд здание влд владение".split()
GENERIC = "компания торговый дом группа производственное объединение предприятие центр фирма научно производственная холдинг управление комбинат".split()
#: Transliteration of letters, and the letters of the other spelling.
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split()))
LATIN_OTHER = LATIN | {"х": "h", "ц": "c", "щ": "sch", "ю": "u", "й": "i"}

_or = "|".join
_NUMBERS = r"(?<!\d)(?:\d{12}|\d{10}|\d{15}|\d{13})(?!\d)"
_KPPS = r"(?<![\dA-Z])\d{4}[\dA-Z]{2}\d{3}(?![\dA-Z])"
_LABELLED = r"ИНН\D{0,12}?(\d{12}|\d{10})(?!\d)"
_QUOTES = "[\"«»“”„'`]"
_PLACE = rf"(?iu)(?:^|[\s,])(?:{_or(PLACES)})(?:\.\s*|\s+)([А-ЯЁ][А-Яа-яЁё-]{{2,}})"
_STREET = rf"(?iu)(?:^|(?<=[\s,.]))(?:{_or(STREETS)})\.?\s+([А-ЯЁ0-9][А-Яа-яЁё0-9-]{{2,}})"
_HOUSE = rf"(?iu)(?:^|[\s,])(?:{_or(HOUSES)})\.?\s*(\d+)"

#: Signals in their order.
SIGNALS = ("INN_ON_SITE", "OGRN_ON_SITE", "ID_ONLY_IN_WARNING_CONTEXT", "KPP_ON_SITE", "EXACT_LEGAL_NAME", "REGISTERED_LOCALITY", "REGISTERED_STREET_ADDRESS", "DIRECTORY_LIKE")


def folded(text: Column) -> Column:
    """Small letters, one е, straight quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё«»“”", 'е""""'), r"\s+", " "))


def name_core(name: Column) -> Column:
    """A legal name without its form and quotes; null below three characters."""
    bare = F.regexp_replace(folded(name), rf"^(?:{_or(LEGAL_FORMS)})\s+", "")
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, _QUOTES, " "), r"\s+", " "), r"^[ -]+|[ -]+$", "")
    return F.when(F.length(core) >= 3, core)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit("\\"), F.lit("")), F.lit(r"\E"))


def _named(plain: Column, core: Column) -> Column:
    """Whether a name stands in the text as words of its own; the pattern runs only where the name occurs at all."""
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_-])"), _quoted(core), F.lit(r"(?![\p{L}\p{N}_])"))
    return F.when(F.contains(plain, core), F.regexp_like(plain, whole)).otherwise(False)


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def identity_facts(identities: DataFrame) -> DataFrame:
    """What pages are searched for: numbers, name cores, and the registered place, street and house."""
    part = lambda pattern: F.nullif(folded(F.regexp_extract("address", pattern, 1)), F.lit(""))
    cores = F.array_compact(F.array(name_core(F.col("legal_name")), name_core(F.col("short_name"))))
    return identities.select("supplier_id", "inn", "ogrn", "kpp", cores.alias("cores"), part(_PLACE).alias("place"), part(_STREET).alias("street"), part(_HOUSE).alias("house"))


def page_signals(rows: DataFrame) -> DataFrame:
    """What one page says of a supplier: rows with text, html and the
    supplier's ``identity_facts``.  A null says nothing."""
    none = F.array().cast("array<struct<at:int,raw:string,before:string,after:string>>")
    found = F.concat(*[F.coalesce(occurrences(F.col(c), _NUMBERS, WARNED_BEFORE, WARNED_AFTER), none) for c in ("text", "html")])
    warned = lambda o: F.concat(o["before"], o["raw"], o["after"]).rlike(f"(?iu){_or(WARNING)}")
    own = F.transform(F.filter(found, lambda o: _some((o["raw"] == F.col("inn")) | (o["raw"] == F.col("ogrn")))), lambda o: F.struct(o["raw"].alias("raw"), warned(o).alias("warned")))
    others = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(_LABELLED), F.lit(1))), lambda x: ~x.eqNullSafe(F.col("inn")))
    seen = lambda c: _some(F.exists("_own", lambda o: (o["raw"] == F.col(c)) & ~o["warned"]))
    rows = rows.withColumns({"_own": own, "_folded": folded(F.col("text"))}).withColumn("_plain", F.trim(F.regexp_replace(F.regexp_replace("_folded", _QUOTES, " "), r"\s+", " ")))
    behind = F.slice(F.split("_folded", _quoted(F.col("street"))), 2, 1_000_000_000)
    at_house = F.exists(behind, lambda x: F.array_contains(F.regexp_extract_all(F.left(x, F.lit(HOUSE_WITHIN)), F.lit(r"\d+"), F.lit(0)), F.col("house")))
    return rows.withColumns({
        "inn_seen": seen("inn"), "ogrn_seen": seen("ogrn"), "any_warned": _some(F.exists("_own", lambda o: o["warned"])),
        "kpp_seen": _some(F.array_contains(F.regexp_extract_all("text", F.lit(_KPPS), F.lit(0)), F.col("kpp"))),
        "named": _some(F.exists("cores", lambda c: _named(F.col("_plain"), c))),
        "place_seen": _some(F.contains(F.col("_folded"), F.col("place"))), "street_seen": _some(at_house),
        "others": F.coalesce(F.slice(others, 1, OTHERS), F.array().cast("array<string>")),
    }).drop("_own", "_folded", "_plain")


def graded(pages: DataFrame, identities: DataFrame) -> DataFrame:
    """Grade of every (site, supplier_id) pair.

    pages: site, supplier_id (the candidate owner), text, html; identities: one
    row per supplier_id with inn, ogrn, kpp, legal_name, short_name, address.
    HIGH: the supplier's own number outside warnings, or its exact name with the
    registered street and house or its registration code; MEDIUM: name and place
    only; LOW: anything else, a number in warnings alone, or a directory with
    three other companies' numbers.  Only HIGH verifies a site.  Pages of
    unknown suppliers give nothing; a page keeps at most three other numbers,
    which decide the same as all.
    """
    judged = page_signals(pages.select("site", "supplier_id", "text", "html").join(identity_facts(identities), "supplier_id"))
    marks = ("inn_seen", "ogrn_seen", "any_warned", "kpp_seen", "named", "place_seen", "street_seen")
    # pages of one site are folded into flags first, their other numbers into distinct rows: no list grows with the site
    flags = judged.select("site", "supplier_id", *marks, F.explode_outer("others").alias("other")).groupBy("site", "supplier_id", "other").agg(*[F.bool_or(c).alias(c) for c in marks])
    site = flags.groupBy("site", "supplier_id").agg(*[F.bool_or(c).alias(c) for c in marks], F.count("other").alias("others"))
    has = {
        "INN_ON_SITE": F.col("inn_seen"), "OGRN_ON_SITE": F.col("ogrn_seen"), "ID_ONLY_IN_WARNING_CONTEXT": F.col("any_warned") & ~F.col("inn_seen") & ~F.col("ogrn_seen"), "KPP_ON_SITE": F.col("kpp_seen"),
        "EXACT_LEGAL_NAME": F.col("named"), "REGISTERED_LOCALITY": F.col("place_seen"), "REGISTERED_STREET_ADDRESS": F.col("street_seen"), "DIRECTORY_LIKE": F.col("others") >= OTHERS,
    }
    number = has["INN_ON_SITE"] | has["OGRN_ON_SITE"]
    grade = F.when(has["DIRECTORY_LIKE"] | has["ID_ONLY_IN_WARNING_CONTEXT"], "LOW").when(number | (F.col("named") & (F.col("street_seen") | F.col("kpp_seen"))), "HIGH").when(F.col("named") & F.col("place_seen"), "MEDIUM").otherwise("LOW")
    status = F.when(grade != "HIGH", "REJECTED").when(number, "VERIFIED_STRONG").otherwise("VERIFIED_COMPOSITE")
    return site.select("site", "supplier_id", F.array_compact(F.array(*[F.when(has[s], s) for s in SIGNALS])).alias("signals"), grade.alias("grade"), status.alias("status"))


def latin(text: Column, table: dict[str, str] = LATIN) -> Column:
    """Transliteration; the signs for hard and soft go."""
    for letter, to in table.items():
        if len(to) > 1:
            text = F.replace(text, F.lit(letter), F.lit(to))
    single = {a: b for a, b in table.items() if len(b) == 1 and b != "-"}
    return F.translate(text, "".join(single) + "ъь", "".join(single.values()))


def host_guesses(name: Column, endings: tuple[str, ...] = ("ru", "com", "рф"), limit: int = 8) -> Column:
    """Host names that a legal name may have, in order, at most ``limit``; they
    are guesses, to be verified like any site.  Null without a name."""
    words = F.filter(F.split(F.replace(name_core(name), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}_-]+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(GENERIC))
    kept = F.when(F.size(telling) > 0, telling).otherwise(words)
    slugs = [F.array_join(kept, "-"), F.array_join(kept, "")]
    clean = lambda c, chars: F.regexp_replace(F.regexp_replace(c, f"[^{chars}0-9-]", ""), "^-+|-+$", "")
    hosts = [F.when(F.length(h) >= 3, F.concat(h, F.lit(f".{e}"))) for t in (LATIN, LATIN_OTHER) for s in slugs for h in (clean(latin(s, t), "a-z"),) for e in endings if e != "рф"]
    own = clean(slugs[0], "а-я")
    hosts += [F.when(F.length(own) >= 3, F.concat(own, F.lit(".рф")))] if "рф" in endings else []
    return F.when(kept.isNotNull(), F.slice(F.array_distinct(F.array_compact(F.array(*hosts))), 1, limit))
