"""Identity of sites, page by page, and guesses of host names."""

import pytest
from pyspark.sql import functions as F

from lotlight.operators import websites

WHO = (7, "7701234567", "1027700000001", "770101001", 'ООО "Ромашка-Опт"', None, "119019, г. Калуга, ул. Ленина, д. 12, оф. 3")
FAR = " слово" * 200

CASES = {
    "own.ru": (["О нас. ИНН 7701234567"], "INN_ON_SITE", "HIGH", "VERIFIED_STRONG"),
    "registry.ru": (["ОГРН: 1027700000001"], "OGRN_ON_SITE", "HIGH", "VERIFIED_STRONG"),
    "longer.ru": (["ИНН 77012345678 и 17701234567"], "", "LOW", "REJECTED"),
    "warning.ru": (["Осторожно, мошенники! ИНН 7701234567, Ромашка-Опт, КПП 770101001"], "ID_ONLY_IN_WARNING_CONTEXT KPP_ON_SITE EXACT_LEGAL_NAME", "LOW", "REJECTED"),
    "both.ru": (["Осторожно, мошенники!" + FAR + " ИНН 7701234567"], "INN_ON_SITE", "HIGH", "VERIFIED_STRONG"),
    "behind.ru": (["ИНН 7701234567 сайт не принадлежит компании"], "ID_ONLY_IN_WARNING_CONTEXT", "LOW", "REJECTED"),
    "street.ru": (["«РОМАШКА-ОПТ»", "Калуга, Ленина, дом 12"], "EXACT_LEGAL_NAME REGISTERED_LOCALITY REGISTERED_STREET_ADDRESS", "HIGH", "VERIFIED_COMPOSITE"),
    "house.ru": (["Ромашка-Опт, Калуга, Ленина, дом 121"], "EXACT_LEGAL_NAME REGISTERED_LOCALITY", "MEDIUM", "REJECTED"),
    "faraway.ru": (["Ромашка-Опт, Ленина" + FAR + " 12"], "EXACT_LEGAL_NAME", "LOW", "REJECTED"),
    "second.ru": (["Ромашка-Опт, Ленина" + FAR + " ул. Ленина, 12"], "EXACT_LEGAL_NAME REGISTERED_STREET_ADDRESS", "HIGH", "VERIFIED_COMPOSITE"),
    "code.ru": (["Ромашка-Опт КПП 770101001"], "KPP_ON_SITE EXACT_LEGAL_NAME", "HIGH", "VERIFIED_COMPOSITE"),
    "alike.ru": (["Ромашка-Оптовик, Калуга; наша-Ромашка-Опт"], "REGISTERED_LOCALITY", "LOW", "REJECTED"),
    "list.ru": (["ИНН 7701234567, ИНН 1111111111", "ИНН: 222222222222, ИНН 1111111111", "ИНН № 3333333333"], "INN_ON_SITE DIRECTORY_LIKE", "LOW", "REJECTED"),
    "two.ru": (["ИНН 7701234567, ИНН 1111111111, ИНН 1111111111", "ИНН: 222222222222"], "INN_ON_SITE", "HIGH", "VERIFIED_STRONG"),
    "empty.ru": ([None, ""], "", "LOW", "REJECTED"),
}


@pytest.fixture(scope="module")
def identities(spark):
    return spark.createDataFrame([WHO, (8, None, None, None, None, None, None)], "supplier_id int, inn string, ogrn string, kpp string, legal_name string, short_name string, address string").withColumn("text", F.lit("clash"))


def test_grades(spark, identities):
    rows = [(site, 7, t, None) for site, (texts, *_) in CASES.items() for t in texts] + [("html.ru", 7, "", "<b>7701234567</b>"), ("nobody.ru", 8, "ИНН 7701234567", "x"), ("unknown.ru", 9, "ИНН 7701234567", "x")]
    pages = spark.createDataFrame(rows, "site string, supplier_id int, text string, html string").withColumn("inn", F.lit("clash"))
    got = {r["site"]: (" ".join(r["signals"]), r["grade"], r["status"]) for r in websites.graded(pages.repartition(4), identities).collect()}
    assert got.pop("html.ru") == ("INN_ON_SITE", "HIGH", "VERIFIED_STRONG")
    assert got.pop("nobody.ru") == ("", "LOW", "REJECTED")
    assert got == {site: tuple(want) for site, (_, *want) in CASES.items()}
    assert websites.graded(pages.limit(0), identities).count() == 0


def test_name_cores_and_hosts(spark):
    names = ['ООО "Компания «Тёплый Дом»"', "ПАО «Щит и Ключ»", "ИП Юрьев", "АО «Центр»", "ип", None]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", websites.name_core(F.col("n")).alias("core"), websites.host_guesses(F.col("n")).alias("hosts"))
    got = {r["i"]: (r["core"], r["hosts"]) for r in df.collect()}
    assert [got[i][0] for i in range(6)] == ["компания теплый дом", "щит и ключ", "юрьев", "центр", None, None]
    assert got[0][1] == ["teplyy.ru", "teplyy.com", "teplyi.ru", "teplyi.com", "теплый.рф"]
    assert got[1][1] == ["shchit-i-klyuch.ru", "shchit-i-klyuch.com", "shchitiklyuch.ru", "shchitiklyuch.com", "schit-i-kluch.ru", "schit-i-kluch.com", "schitikluch.ru", "schitikluch.com"]
    assert got[2][1] == ["yurev.ru", "yurev.com", "urev.ru", "urev.com", "юрьев.рф"]
    assert got[3][1] == ["tsentr.ru", "tsentr.com", "centr.ru", "centr.com", "центр.рф"] and got[4][1] is None and got[5][1] is None
