"""Personal data replaced by surrogates, in SQL expressions only.

Detected are e-mail addresses, IPv4 and IPv6 addresses, international account
numbers (IBAN), telephone and identity numbers, card and account numbers, secret
keys in hex, and personal names (a known first name and a family name, both
capitalised or both in capitals, in Latin or Cyrillic script).  A family name
that stands alone in a text that has it in a full name follows that name (the
first one, if several share it).

A surrogate is derived from a keyed hash of the kind and the canonical form
of an entity, so the same entity gets the same surrogate everywhere, also in
other letter case or punctuation.  It has the type and format of what it
replaces: separators, country code, letter case and number lengths stay, card
numbers that pass the Luhn check still do, first names keep gender and script,
and Cyrillic family names take the ending of the gender.

Collisions are checked over the whole corpus: the distinct entities are
gathered, and an entity whose surrogate equals another's surrogate, or a real
entity, draws again until all are distinct.  Few entities ever draw again;
only documents that hold one of them are joined with its draw.

Defined cases: null texts stay null, texts without entities stay as they are;
an empty key is refused; repeated rows get equal surrogates; rows with a null doc_id
are treated like any other; texts of any length are read whole, and no pattern
recurses deeper than a fixed bound; all other columns pass through unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small_join

#: First names by script and gender.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Clara Diana Elena Emily Emma Eva Hannah Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucy Maria Marie Martha Mary Monica Nancy Olivia Patricia Paula Rachel Rosa Sarah Silvia Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anton Carlos Charles Daniel David Edward Eric Francis Frank George Hans Henry Hugo Ivan Jack James Jean Johannes John Jose Joseph Juan Karl Louis Luis Martin Michael Miguel Oliver Oscar Pablo Paul Pedro Peter Pierre Robert Samuel Stefan Thomas Victor Walter William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Вера Нина Людмила Галина".split(),
    ("cyrillic", "m"): "Иван Пётр Петр Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Александр Павел Борис Виктор Олег".split(),
}
#: Syllables of family names.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на не но па по ра ре ро са та то".split(),
}
_latin = "rson ley man ton field ner well der".split()
ENDINGS = {("latin", "f"): _latin, ("latin", "m"): _latin, ("cyrillic", "f"): "рова лина нева това".split(), ("cyrillic", "m"): "ров лин нев тов".split()}

_all_names = "|".join(n for names in NAMES.values() for n in names)
_cap = r"(?=[A-ZА-ЯЁ])"
_edge, _end = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_group = "[0-9A-Fa-f]{1,4}"
#: The kinds, in order of precedence, and their patterns.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "iban": rf"{_edge}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,6}} ?[A-Z0-9]{{1,4}}{_end}",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_group}:){{7}}{_group}|(?=[0-9A-Fa-f:]{{0,30}}[0-9])(?:{_group}:){{1,6}}(?::{_group}){{1,6}})(?![0-9A-Za-z:]|\.[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": rf"{_edge}{_cap}(?:(?:{_all_names}) \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?|(?:{_all_names.upper()}) \p{{Lu}}{{2,}}+(?:-\p{{Lu}}{{2,}}+)?){_end}",
}
PATTERN = "|".join(KINDS.values())
ROUNDS = 20


def kind(match: Column) -> Column:
    """The kind of a match, by its characters."""
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "secret")
        .when(match.rlike("^[0-9A-Fa-f]{1,4}:"), "ip6")
        .when(match.rlike(rf"^{KINDS['ip']}$"), "ip")
        .when(match.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(match.rlike(rf"^{KINDS['card']}$"), "card")
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "identity")
        .when(match.rlike("^[+(0-9]"), "phone")
        .otherwise("name")
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def canonical(match: Column, k: Column) -> Column:
    """Kind and the form in which two writings of an entity are equal."""
    form = (
        F.when(k.isin("card", "identity"), digits(match))
        .when(k == "iban", F.regexp_replace(match, " ", ""))
        .when(k == "ip6", F.lower(match))
        .when(k == "phone", F.when(F.length(digits(match)) > 10, digits(match)).otherwise(F.concat(F.lit("1"), digits(match))))
        .when(k.isin("email", "secret", "name"), F.lower(match))
        .otherwise(match)
    )
    return F.concat_ws(":", k, form)


def _hash(key: str, parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(key + "\u001f"), parts), 256)


def _number(hex_text: Column, place: int, below: int) -> Column:
    """A number under ``below`` from 12 hex characters."""
    return F.pmod(F.conv(F.substring(hex_text, place, 12), 16, 10).cast("long"), F.lit(below))


def _stream(hex_text: Column, alphabet: str) -> Column:
    """64 characters of an alphabet, one for each hex character and its neighbour."""
    n = len(alphabet)
    twice = F.concat(hex_text, hex_text)
    at = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(F.conv(F.substring(twice, i, F.lit(4)), 16, 10).cast("int"), F.lit(n)))
    return F.array_join(F.transform(at, lambda x: F.substring(F.lit(alphabet), x + 1, F.lit(1))), "")


def _fill(text: Column, new: Column, places: str) -> Column:
    """``text`` with its characters in ``places`` replaced, in order, by those of ``new``."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
    step = lambda s, c: F.when(c.rlike(f"^[{places}]$"), F.struct(F.concat(s["o"], F.substring(new, s["k"], F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k"))
    )
    return F.aggregate(F.split(text, ""), start, step)["o"]


def _fill_digits(text: Column, new: Column) -> Column:
    return _fill(text, new, "0-9")


def _iban(match: Column, number: Column, letters: Column) -> Column:
    """Country, letters' and digits' places stay; the check digits are right if they were."""
    own = F.regexp_replace(match, " ", "")
    body = _fill(_fill_digits(F.substring(own, F.lit(5), F.length(own)), number), F.upper(letters), "A-Z")

    def rest(number: Column) -> Column:  # of the division by 97, letters being 10 to 35
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.aggregate(F.split(number, ""), F.lit(0), lambda a, c: (a * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)

    country = F.substring(own, 1, 2)
    check = 98 - rest(F.concat(body, country, F.lit("00")))
    good = rest(F.concat(F.substring(own, F.lit(5), F.length(own)), F.substring(own, 1, 4))) == 1
    check = F.lpad(F.when(good, check).otherwise(check % 97 + 1).cast("string"), 2, "0")
    new = F.concat(country, check, body)
    return _fill(match, new, "A-Z0-9")


def _luhn(number: Column) -> Column:
    """Sum of the Luhn check, modulo 10."""
    turned = F.split(F.reverse(number), "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(turned, weigh), F.lit(0), lambda a, x: a + x) % 10


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _cased(new: Column, old: Column) -> Column:
    """``new`` in the letter case of ``old``."""
    return F.when((F.upper(old) == old) & (F.lower(old) != old) & (F.length(old) > 1), F.upper(new)).when(F.substring(old, 1, 1).rlike(r"^\p{Lu}$"), F.initcap(new)).otherwise(new)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def _name(match: Column, h: Column) -> Column:
    first = F.initcap(F.split(match, " ")[0])
    out = F.lit(None).cast("string")
    for (script, gender), names in NAMES.items():
        family = F.initcap(F.concat(*[_pick(SYLLABLES[script], _number(h, 13 + 12 * i, len(SYLLABLES[script]))) for i in range(3)], _pick(ENDINGS[script, gender], _number(h, 49, len(ENDINGS[script, gender])))))
        out = F.when(first.isin(names), F.concat_ws(" ", _pick(names, _number(h, 1, len(names))), family)).otherwise(out)
    return F.when((F.upper(match) == match) & (F.lower(match) != match), F.upper(out)).otherwise(out)


def _email(match: Column, number: Column, letters: Column, domain_hash: Column) -> Column:
    user, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    # the first letters of the user part give way to eight letters; digits and marks keep their places
    parts = r"^([^\p{L}]*)(\p{L}*)(.*)$"
    front, word, rest = (F.regexp_extract(user, parts, i) for i in (1, 2, 3))
    new = F.concat(
        _fill_digits(front, number),
        _cased(F.substring(letters, 1, 8), F.when(word == "", F.lit("x")).otherwise(word)),
        _fill_digits(F.regexp_replace(rest, r"\p{L}", "x"), F.substring(number, 20, 40)),
    )
    label = F.concat(F.substring(_stream(domain_hash, LETTERS), 1, 7), F.lit("."), F.lower(F.substring_index(domain, ".", -1)))
    return F.concat(new, F.lit("@"), F.when((F.upper(domain) == domain), F.upper(label)).otherwise(label))


def _secret(match: Column, key: str, h: Column) -> Column:
    long = F.concat(*[_hash(key, F.concat_ws("\u001f", h, F.lit(i))) for i in range(4)])
    repeated = F.repeat(long, F.ceil(F.length(match) / 256).cast("int"))
    new = F.substring(repeated, F.lit(1), F.length(match))
    return F.when(F.upper(match) == match, F.upper(new)).otherwise(new)


def _card(match: Column, number: Column) -> Column:
    own = digits(match)
    body = F.concat(F.substring(own, 1, 1), F.substring(number, F.lit(1), F.length(own) - 2))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    drawn = F.substring(number, 30, 1).cast("int")
    # a number that fails the check gets another one that fails
    last = F.when(_luhn(own) == 0, check).otherwise(F.when(drawn == check, (drawn + 1) % 10).otherwise(drawn))
    return _fill_digits(match, F.concat(body, last.cast("string")))


def _phone(match: Column, number: Column) -> Column:
    own = digits(match)
    country = F.greatest(F.length(own) - 10, F.when(match.startswith("+"), F.lit(1)).otherwise(F.lit(0)))
    return _fill_digits(match, F.concat(F.substring(own, F.lit(1), country), number))


def with_surrogates(df: DataFrame, key: str, draw) -> DataFrame:
    """Turn ``_m``, an array of matches, into ``_new``, their replacements.

    ``draw`` gives the number of an entity's draw from its form.  Each step is
    a projection of its own, so that nothing is computed twice.
    """
    us = "\u001f"

    def step(df: DataFrame, make) -> DataFrame:
        return df.withColumn("_m", F.transform("_m", make))

    df = step(df, lambda m: F.struct(m.alias("m"), kind(m).alias("k")))
    df = step(df, lambda e: F.struct(e["m"].alias("m"), e["k"].alias("k"), canonical(e["m"], e["k"]).alias("f")))
    df = step(df, lambda e: F.struct(e["m"].alias("m"), e["k"].alias("k"), _hash(key, F.concat_ws(us, e["f"], draw(e["f"]).cast("string"))).alias("h")))

    def streams(e: Column) -> Column:
        email = e["k"] == "email"
        return F.struct(
            e["m"].alias("m"), e["k"].alias("k"), e["h"].alias("h"),
            F.when(e["k"].isin("email", "card", "identity", "phone", "iban"), _stream(e["h"], "0123456789")).alias("n"),
            F.when(email | (e["k"] == "iban"), _stream(F.reverse(e["h"]), LETTERS)).alias("l"),
            F.when(email, _hash(key, F.concat_ws(us, F.lit("domain"), F.lower(F.substring_index(e["m"], "@", -1))))).alias("d"),
        )

    def last(e: Column) -> Column:
        m, k, h, n = e["m"], e["k"], e["h"], e["n"]
        ip = F.concat_ws(".", *[(_number(h, 1 + 12 * i, 254) + 1).cast("string") for i in range(4)])
        return (
            F.when(k == "email", _email(m, n, e["l"], e["d"]))
            .when(k == "secret", _secret(m, key, h))
            .when(k == "ip", ip)
            .when(k == "ip6", F.when(F.upper(m) == m, F.upper(_fill(m, h, "0-9A-Fa-f"))).otherwise(_fill(m, h, "0-9A-Fa-f")))
            .when(k == "iban", _iban(m, n, e["l"]))
            .when(k == "card", _card(m, n))
            .when(k == "identity", _fill_digits(m, n))
            .when(k == "phone", _phone(m, n))
            .otherwise(F.coalesce(_name(m, h), m))
        )

    return step(step(df, streams), last).withColumnRenamed("_m", "_new")


def found(text: str = "text") -> Column:
    """All matches in a text, in order."""
    return F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))


def _form(match: Column) -> Column:
    return canonical(match, kind(match))


def _lone_names(piece: Column, old: Column, new: Column) -> Column:
    """A stretch of text between entities, the family names of ``old`` in it
    replaced by those of ``new``; one pattern holds all of them."""
    pattern = F.concat(F.lit(_edge + "(?:"), F.array_join(F.transform(old, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|"), F.lit(")" + _end))
    alone = F.transform(F.regexp_extract_all(piece, pattern, F.lit(0)), lambda n: F.element_at(new, F.array_position(old, n).cast("int")))
    return F.array_join(F.zip_with(F.split(piece, pattern, -1), alone, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def draws(docs: DataFrame, key: str) -> DataFrame:
    """form and draw of the entities whose first surrogate collides.

    Each distinct form is checked by the surrogate of one of its writings.
    """
    matches = docs.filter(F.col("text").isNotNull()).select(F.explode(found()).alias("match"))
    named = matches.groupBy("match").count().select("match", _form(F.col("match")).alias("form"))
    forms = cut(named.groupBy("form").agg(F.min("match").alias("match")))
    state, settled = forms.withColumn("draw", F.lit(0)), None
    for _ in range(ROUNDS):
        tried = with_surrogates(state.withColumn("_m", F.array("match")), key, lambda f: F.col("draw"))
        tried = tried.select("form", "match", "draw", _form(F.col("_new")[0]).alias("new"))
        tried = cut(tried)
        # of equal surrogates the one of the smallest form stays; settled ones come before
        rows = tried.select("new", "form") if settled is None else tried.select("new", "form").unionByName(settled.select("new", F.lit("").alias("form")))
        first = rows.groupBy("new").agg(F.min("form").alias("winner"), F.count("*").alias("n")).filter("n > 1")
        real = forms.select(F.col("form").alias("new"), F.lit(True).alias("real"))
        judged = tried.join(first.hint("merge"), "new", "left").join(real.hint("merge"), "new", "left")
        lost = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("winner") != F.col("form"), F.lit(False))
        judged = cut(judged.select("form", "match", "draw", "new", lost.alias("lost")))
        good = judged.filter("not lost").select("form", "draw", "new")
        settled = good if settled is None else settled.unionByName(good)
        state = judged.filter("lost").select("form", "match", (F.col("draw") + 1).alias("draw"))
        if not state.take(1):
            break
    else:
        raise RuntimeError(f"surrogates still collide after {ROUNDS} draws")
    return settled.filter("draw > 0").select("form", "draw")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``; it is read twice and must be stable."""
    if not key:
        raise ValueError("surrogates need a key")
    again = cut(draws(docs, key))
    names = docs.columns
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc")
    rows = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_text"), doc)
    marked, draw = rows.withColumn("_m", found("_text")), lambda f: F.lit(0)
    if again.take(1):
        # documents that hold an entity with a later draw carry these draws along
        holders = docs.select(doc, F.explode(found()).alias("match")).select("_doc", _form(F.col("match")).alias("form")).distinct()
        held = cut(holders.join(again.hint("merge"), "form").groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("form", "draw"))).alias("_draws")))
        marked = small_join(marked, held, ["_doc"], held.count(), how="left")
        draw = lambda f: F.coalesce(F.element_at("_draws", f), F.lit(0))
    done = with_surrogates(marked.withColumn("_old", F.col("_m")), key, draw)
    # old and new family names of the text's full names; the first of equal ones counts
    last = lambda m: F.substring_index(m, " ", -1)
    both = F.filter(F.zip_with("_old", "_new", lambda o, n: F.when(kind(o) == "name", F.struct(last(o).alias("old"), last(n).alias("new")))), lambda p: p.isNotNull())
    done = done.withColumn("_names", both).withColumn("_family", F.array_distinct(F.col("_names.old")))
    done = done.withColumn("_instead", F.transform("_family", lambda n: F.element_at(F.col("_names.new"), F.array_position(F.col("_names.old"), n).cast("int"))))
    pieces = F.split(F.col("_text"), PATTERN, -1)
    pieces = F.when(F.size("_family") > 0, F.transform(pieces, lambda p: _lone_names(p, F.col("_family"), F.col("_instead")))).otherwise(pieces)
    text = F.when(F.size("_new") > 0, F.array_join(F.zip_with(pieces, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("_text"))
    return done.select(*[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names])
