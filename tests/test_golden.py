"""Contacts scored against golden values, supplier by supplier."""

from lotlight.operators import golden


def test_scores(spark):
    rows = [
        (1, ["own.ru"], None, ["78121112233"], ["78124445566"], ["info@own.ru"], None), (2, ["own.spb.ru"], ["other.ru"], ["79210000000"], None, None, None), (3, [], None, None, None, None, ["boss@x.ru"]),
        (4, None, None, None, None, None, None), (5, ["a.ru"], None, None, None, None, None), (6, ["a.ru"], None, None, None, None, None),
    ]
    gold = spark.createDataFrame(rows, "supplier_id int, domains array<string>, same_domains array<string>, phones array<string>, bad_phones array<string>, emails array<string>, bad_emails array<string>")
    found = spark.createDataFrame([(1, "https://www.own.ru/about"), (2, "http://shop.other.ru"), (3, "http://any.ru"), (5, None), (6, "http://b.ru"), (9, "http://own.ru")], "supplier_id int, website string")
    contacts = spark.createDataFrame(
        [(1, "PHONE", "+7 (812) 111-22-33"), (1, "PHONE", "8 812 444-55-66"), (1, "PHONE", "123"), (1, "EMAIL", " Info@Own.ru "), (3, "EMAIL", "boss@x.ru"), (3, "EMAIL", "who@x.ru"), (9, "EMAIL", "info@own.ru")],
        "supplier_id int, kind string, raw string",
    )
    verdicts = golden.website_verdicts(gold, found)
    assert {r["supplier_id"]: r["verdict"] for r in verdicts.collect()} == {1: "CORRECT", 2: "SAME_COMPANY_UNVERIFIABLE", 3: "WRONG_COMPANY", 4: "CORRECT_NONE", 5: "MISSED", 6: "WRONG_COMPANY"}
    values = golden.golden_values(gold)
    out = {r["kind"]: tuple(r)[1:] for r in golden.scores(gold, verdicts, values, golden.value_verdicts(values, contacts)).collect()}
    assert out == {"WEBSITE": (4, 4, 1, 4, 1, 2, 1, 25.0, 25.0), "PHONE": (2, 1, 1, 3, 1, 1, 1, 50.0, 33.3), "EMAIL": (1, 2, 1, 3, 1, 1, 1, 100.0, 33.3)}
    empty = golden.scores(gold.limit(0), golden.website_verdicts(gold.limit(0), found), values.limit(0), golden.value_verdicts(values, contacts))
    assert {tuple(r)[1:] for r in empty.collect()} == {(0, 0, 0, 0, 0, 0, 0, None, None)}


def test_invented(spark):
    contacts = spark.createDataFrame(
        [(1, "PHONE", "8 812 111-22-33", "FIRST_PARTY", "u"), (1, "PHONE", "8 812 111-22-34", "FIRST_PARTY", "u"), (1, "EMAIL", "Info@own.ru", "FIRST_PARTY", "u"), (1, "EMAIL", "x@own.ru", "FIRST_PARTY", "gone"), (1, "EMAIL", "x@own.ru", "REGISTRY", "u")],
        "supplier_id int, kind string, raw string, source_type string, source_url string",
    )
    pages = spark.createDataFrame([("u", "+7 (812) 111 22 33 INFO@own.ru"), ("v", None)], "url string, text string")
    got = {(r["value"], r["source_url"]): r["present"] for r in golden.invented(contacts, pages).collect()}
    assert got == {("78121112233", "u"): True, ("78121112234", "u"): False, ("info@own.ru", "u"): True, ("x@own.ru", "gone"): None}
