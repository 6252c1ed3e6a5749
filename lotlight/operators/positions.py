"""Contacts judged by where they stand: occurrences of a pattern with bounded windows of text around them.

A text is cut once into matches and the gaps between them.  One fold from the
left carries the last characters before each match, one from the right the
first characters behind it, so the work grows with the text and not with
matches times text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

BEFORE, AFTER, LABEL = 90, 40, 25

#: How numbers and addresses are written.
PHONE = r"(?<![\d+])(?:\+7|8)[\s \-–(]*\d{3,5}[\s \-–)]*\d{1,3}[\s \-–]*\d{2}[\s \-–]*\d{2}(?!\d)"
EMAIL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}(?![\w-])"
#: Words of a person (roles, endings of patronymics, a role before a capital letter) and labels of a fax.
ROLES = "директор бухгалтер руководител заместител".split()
NAMED_ROLES = "менеджер специалист".split()
PATRONYMICS = "ович евич ьич овна евна ична инична".split()
FAX = r"(?:факс|fax|ф\.)\s*[:.]?\s*$"
PHONE_AND_FAX = r"тел[\p{L}\p{N}_]*\.?\s*/\s*(?:факс|fax)\s*[:.]?\s*$"
#: Mailboxes of an office, providers of free mail, endings of surnames in Latin letters, domains and endings that are no contact.
OFFICE = """info sales office zakaz order orders mail secretary priem priemnaya opt market marketing client clients hello contact contacts post
sale torg snab tender tenders general company reception kanc kancelyariya support service shop manager otdel help zakupki purchase
procurement commerce kommerc dir director buh hr personal pr press yur legal""".split()
FREE_MAIL = "mail.ru bk.ru list.ru inbox.ru internet.ru yandex.ru ya.ru yandex.com gmail.com rambler.ru lenta.ru ro.ru outlook.com hotmail.com icloud.com".split()
SURNAMES = "ov ev ova eva in ina yn yna sky skiy skaya skii enko chuk yuk uk ich".split()
NO_DOMAIN = "example.com sentry.io wixpress.com domain.ru site.ru mail.example".split()
NO_ENDING = "png jpg jpeg gif svg webp css js".split()

_or = "|".join
PERSON = rf"(?iu:{_or(ROLES)})|(?iu:{_or(NAMED_ROLES)})\s+[А-ЯЁа-яё]|(?<!\p{{L}})[А-ЯЁ][а-яё]+(?:{_or(PATRONYMICS)})(?![\p{{L}}\p{{N}}_])"
#: An initial and a name, two names with a sign between, or a surname.
PERSON_BOX = rf"(?i)^(?:[a-z]{{1,2}}[._-][a-z]{{3,}}|[a-z]{{3,}}[._-][a-z]{{1,2}}|[a-z]{{3,}}[._][a-z]{{3,}}|[a-z]{{2,}}(?:{_or(SURNAMES)}))\d*$"
OFFICE_BOX = rf"(?i)^(?:{_or(OFFICE)})\d*$"

_FOUND = "array<struct<at:int,raw:string,before:string,after:string>>"


def occurrences(text: Column, pattern: str, before: int = BEFORE, after: int = AFTER) -> Column:
    """All matches in order: ``at`` (characters before it), ``raw``, and the
    text just before and behind.  Null for a null text, empty without matches."""
    raws, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def of(cut: Column) -> Column:
        pairs = F.arrays_zip(F.slice(cut["gaps"], 1, F.size(cut["raws"])).alias("gap"), cut["raws"].alias("raw"))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:int,before:string>>").alias("out"))

        def forward(s: Column, x: Column) -> Column:
            here = F.concat(s["tail"], F.right(x["gap"], F.lit(before)))
            seen = F.struct((s["at"] + F.length(x["gap"])).alias("at"), F.right(here, F.lit(before)).alias("before"))
            return F.struct((s["at"] + F.length(x["gap"]) + F.length(x["raw"])).alias("at"), F.right(F.concat(here, x["raw"]), F.lit(before)).alias("tail"), F.concat(s["out"], F.array(seen)).alias("out"))

        # from the right, each match with the gap behind it
        behind = F.reverse(F.arrays_zip(F.slice(cut["gaps"], 2, F.size(cut["raws"])).alias("gap"), cut["raws"].alias("raw")))
        end = F.struct(F.lit("").alias("head"), F.array().cast("array<string>").alias("out"))

        def backward(s: Column, x: Column) -> Column:
            here = F.left(F.concat(F.left(x["gap"], F.lit(after)), s["head"]), F.lit(after))
            return F.struct(F.left(F.concat(x["raw"], here), F.lit(after)).alias("head"), F.concat(s["out"], F.array(here)).alias("out"))

        left = F.aggregate(pairs, start, forward)["out"]
        right = F.reverse(F.aggregate(behind, end, backward)["out"])
        return F.transform(F.arrays_zip(left.alias("l"), cut["raws"].alias("raw"), right.alias("after")), lambda z: F.struct(z["l"]["at"].alias("at"), z["raw"].alias("raw"), z["l"]["before"].alias("before"), z["after"].alias("after")))

    cut = F.transform(F.array(F.struct(raws.alias("raws"), gaps.alias("gaps"))), of)[0]
    return F.when(text.isNotNull(), cut).cast(_FOUND)


def personal(found: Column) -> Column:
    """Whether a contact stands beside words of a person: in the text before
    it, or within ``AFTER`` characters from its start."""
    return F.concat(found["before"], F.left(F.concat(found["raw"], found["after"]), F.lit(AFTER))).rlike(PERSON)


def fax(found: Column) -> Column:
    """Whether a number is labelled as a fax alone."""
    label = F.right(found["before"], F.lit(LABEL))
    return label.rlike(f"(?iu){FAX}") & ~label.rlike(f"(?iu){PHONE_AND_FAX}")


def mailbox_basis(address: Column, domains: Column, site: Column) -> Column:
    """Why an address may be shown, or null: COMPANY_DOMAIN for any box that is
    not a person's, PUBLIC_MAILBOX_ON_OFFICIAL_SITE for an office's or the
    site's own box with free mail."""
    local, host = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    registered = scalars.registrable_domain(host)
    label = F.substring_index(site, ".", 1)
    own = local.rlike(OFFICE_BOX) | ((F.length(label) >= 4) & F.contains(local, label))
    free = registered.isin(FREE_MAIL) | host.isin(FREE_MAIL)
    return F.when(local.rlike(PERSON_BOX), F.lit(None)).when(F.array_contains(domains, registered), "COMPANY_DOMAIN").when(free & own, "PUBLIC_MAILBOX_ON_OFFICIAL_SITE")


def site_contacts(pages: DataFrame, limit: int = 3) -> DataFrame:
    """Contacts of verified sites: pages (site: its registrable domain, no: the
    page's place, text, registered: domain of the registered address or null).

    A number counts once a site, where it is first seen: not beside a person,
    not where all its places on that page are labelled as a fax.  Landlines go
    before mobile numbers, office boxes before others, then by page and place;
    ``limit`` of each kind a site.  A site, page or text that is null gives nothing.
    Free mail is never a company's domain.
    """
    rows = pages.filter("site is not null and no is not null and text is not null")

    def of(pattern: str) -> DataFrame:
        return rows.select("site", "no", "registered", F.explode(occurrences(F.col("text"), pattern)).alias("f"))

    numbers = of(PHONE).withColumn("value", scalars.phone(F.col("f.raw"))).filter("value is not null").withColumns({"_fax": fax(F.col("f")), "_person": personal(F.col("f"))})
    first = numbers.groupBy("site", "no", F.col("f.raw").alias("raw")).agg(F.min("f.at").alias("at"), F.min_by("_person", "f.at").alias("_person"), F.bool_and("_fax").alias("_fax"), F.first("value").alias("value"))
    phones = first.filter("not _person and not _fax").select("site", "no", "at", F.lit("PHONE").alias("kind"), "value", "raw", F.lit(None).cast("string").alias("basis"), (F.substring("value", 2, 1) == "9").alias("later"))
    boxes = of(EMAIL).withColumn("value", F.lower("f.raw")).withColumn("_person", personal(F.col("f")))
    boxes = boxes.groupBy("site", "no", F.col("f.raw").alias("raw"), "value", "registered").agg(F.min("f.at").alias("at"), F.min_by("_person", "f.at").alias("_person"))
    domains = F.array_except(F.array_compact(F.array("site", "registered")), F.array(*map(F.lit, FREE_MAIL)))
    no_contact = F.col("value").rlike(rf"(?:{_or(d.replace('.', '[.]') for d in NO_DOMAIN)}|[.](?:{_or(NO_ENDING)}))$")
    mails = boxes.filter(~F.col("_person") & ~no_contact).withColumn("basis", mailbox_basis(F.col("value"), domains, F.col("site"))).filter("basis is not null")
    mails = mails.select("site", "no", "at", F.lit("EMAIL").alias("kind"), "value", "raw", "basis", (~F.substring_index("value", "@", 1).rlike(OFFICE_BOX)).alias("later"))
    # a value's first place, then the places of the best values: both ranks are pruned before sorting
    once = Window.partitionBy("site", "kind", "value").orderBy("no", "at", "raw")
    best = Window.partitionBy("site", "kind").orderBy("later", "no", "at", "value")
    out = phones.unionByName(mails).withColumn("_n", F.row_number().over(once)).filter("_n = 1").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    return out.select("site", "kind", "place", "value", "raw", "basis", "no")
