"""Places of contacts with their windows, and rules that depend on them."""

import random
import re

from pyspark.sql import functions as F

from lotlight.operators import positions


def test_windows_equal_slices_of_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab12", "é", "x", " ", "\n", "ab7"]) for _ in range(rng.randrange(120))) for _ in range(200)] + ["", None, "ab1", "ab1ab2", "я" * 5000 + "ab1"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", positions.occurrences(F.col("t"), "ab[0-9]+", 9, 4).alias("f"))
    for r in df.collect():
        t = texts[r["i"]]
        want = None if t is None else [(m.start(), m.group(), t[max(0, m.start() - 9) : m.start()], t[m.end() : m.end() + 4]) for m in re.finditer("ab[0-9]+", t)]
        assert (None if r["f"] is None else [tuple(x) for x in r["f"]]) == want


def test_site_contacts(spark):
    far = " слова" * 30
    pages = [
        ("romashka.ru", 1, "Тел.: +7 (812) 111-22-33" + far + " факс: 8 (812) 444-55-66" + far + " Директор Иванов +7 812 777-88-99" + far + " тел./факс: (8) 8 (812) 222-33-44", None),
        ("romashka.ru", 2, "моб. +7 921 123-45-67, +7 812 111 22 33" + far + " Мария Петровна: +7 812 555-66-77", None),
        ("romashka.ru", 3, "i.petrov@romashka.ru zavod@romashka.ru INFO@romashka.ru romashka-opt@mail.ru lilia@mail.ru sales@mail.ru logo@romashka.png info@other.ru", "mail.ru"),
        (None, 1, "+7 812 999-00-00", None),
        ("empty.ru", 1, None, None),
        ("empty.ru", 2, "", None),
    ]
    df = spark.createDataFrame(pages, "site string, no int, text string, registered string")
    got = {}
    for r in positions.site_contacts(df.repartition(5)).orderBy("site", "kind", "place").collect():
        got.setdefault((r["site"], r["kind"]), []).append(r["value"])
    assert got == {("romashka.ru", "PHONE"): ["78121112233", "78122223344", "79211234567"], ("romashka.ru", "EMAIL"): ["info@romashka.ru", "sales@mail.ru", "zavod@romashka.ru"]}
    more = positions.site_contacts(df, 9).filter("kind = 'EMAIL'").collect()
    assert {r["value"]: r["basis"] for r in more} == {
        "info@romashka.ru": "COMPANY_DOMAIN", "zavod@romashka.ru": "COMPANY_DOMAIN", "sales@mail.ru": "PUBLIC_MAILBOX_ON_OFFICIAL_SITE", "romashka-opt@mail.ru": "PUBLIC_MAILBOX_ON_OFFICIAL_SITE"}
    assert positions.site_contacts(df.limit(0)).count() == 0


def test_a_number_labelled_as_fax_only_once_stays(spark):
    df = spark.createDataFrame([("a.ru", 1, "факс: 8 812 111-22-33" + " слово" * 30 + " тел.: 8 812 111-22-33", None)], "site string, no int, text string, registered string")
    assert [r["value"] for r in positions.site_contacts(df).collect()] == ["78121112233"]
