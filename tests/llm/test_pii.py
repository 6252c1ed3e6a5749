import re

from pyspark.sql import functions as F

from lotlight.llm import pii

KEY = "k"


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10


ROWS = [
    (1, "Mail Anna.Muster@mail3.example.com or ANNA.MUSTER@MAIL3.EXAMPLE.COM, call +1 (974) 555-3436 now"),
    (2, "card 4111 1111 1111 1111 and 4111111111111111 and 4111111111111112; ip 10.0.255.1."),
    (3, "Mary Miller met John Smith, then Mary Miller. Анна Петрова и Иван Петров"),
    (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"!!'),
    (5, "clean text with 2024, 3.14, v1.2.3 and no data; Apache License, Version 2.0."),
    (6, None),
    (7, ""),
    (8, "+1 (974) 555-3436"),
    (9, "ê.23@mail3.example.com | 123-45-6789 | 974-555-3436"),
]


def run(spark, rows=ROWS):
    df = spark.createDataFrame([(a, b, "p", "q") for a, b in rows], "doc_id long, text string, _m string, form string").repartition(3)
    return {r.doc_id: r for r in pii.replace(df, KEY).collect()}


def test_replacements_match_type_and_format(spark):
    got = run(spark)
    old = dict(ROWS)
    assert all(got[d].text == old[d] for d in (5, 6, 7)) and got[1]._m == "p" and got[1].form == "q"
    one = re.search(r"Mail (\S+) or (\S+), call (.*) now$", got[1].text)
    assert one[1].lower() == one[2].lower() and one[1] != "Anna.Muster@mail3.example.com" and re.fullmatch(r"[A-Z][a-z]{7}\.x+@[a-z]{7}\.com", one[1])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one[3]) and one[3] != "+1 (974) 555-3436"
    assert got[8].text == one[3]
    assert re.sub(r"\D", "", got[9].text.split("|")[2]) == re.sub(r"\D", "", one[3])[1:]
    a, b, c, ip = re.search(r"card (.{19}) and (\d{16}) and (\d{16}); ip (\S+)\.$", got[2].text).groups()
    assert a.replace(" ", "") == b and luhn(b) == 0 and luhn(c) != 0 and a[0] == "4" and b != "4111111111111111"
    assert re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", ip) and all(1 <= int(x) <= 254 for x in ip.split("."))
    name = re.fullmatch(r"(\w+) (\w+) met (\w+) (\w+), then (\w+ \w+)\. (\w+) (\w+) и (\w+) (\w+)", got[3].text)
    assert f"{name[1]} {name[2]}" == name[5] != "Mary Miller"
    assert name[1] in pii.NAMES["latin", "f"] and name[3] in pii.NAMES["latin", "m"] and name[6] in pii.NAMES["cyrillic", "f"] and name[8] in pii.NAMES["cyrillic", "m"]
    assert name[7].endswith("а") and not name[9].endswith("а")
    low, high = re.findall(r'"([^"]+)"', got[4].text)
    assert low.upper() == high and low != "04dbebab91ab85687d33eeaaf9ac699e1188f962" and len(low) == 40
    for r in got.values():
        assert not any(p in (r.text or "") for p in ("555-3436", "41111111", "Miller", "10.0.255.1", "123-45-6789"))


def test_distinct_entities_stay_distinct_after_collisions(spark, monkeypatch):
    # a surrogate space of few addresses forces collisions and further draws
    small = lambda h, place, below: F.pmod(F.conv(F.substring(h, place, 12), 16, 10).cast("long"), F.lit(3))
    monkeypatch.setattr(pii, "_number", small)
    rows = [(i, f"host 10.0.0.{i + 1} and 10.0.0.{i + 2}") for i in range(30)]
    got = run(spark, rows)
    new = {}
    for d, t in rows:
        for a, b in zip(re.findall(r"[\d.]+\d", t), re.findall(r"[\d.]+\d", got[d].text)):
            assert new.setdefault(a, b) == b
    assert len(set(new.values())) == len(new) == 31 and not set(new) & set(new.values())


def test_native_empty_and_key(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = pii.replace(df, KEY)
    assert out.count() == 0
    import pytest

    with pytest.raises(ValueError):
        pii.replace(df, "")


def test_lone_family_names_capitals_and_ties(spark):
    rows = [(1, "MARY MILLER wrote. Mary Miller again, and Miller's reply; Millers stay, Miller too. mary miller"), (2, "Miller alone is no name here."), (3, "Mary Miller and John Miller: Miller")]
    got = {d: r.text for d, r in run(spark, rows).items()}
    high, new = re.match(r"(\w+ \w+) wrote\. (\w+ \w+) again", got[1]).groups()
    family = new.split()[1]
    assert high == new.upper() and f"and {family}'s reply; Millers stay, {family} too. mary miller" in got[1]
    assert got[2] == rows[1][1] and got[3].startswith(new) and got[3].endswith(f": {family}")


def test_ip6_and_iban(spark):
    rows = [(1, "at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 or fe80::1, 12:30:45, std::vector, a::b"), (2, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432; DE00370400440532013000.")]
    got = {d: r.text for d, r in run(spark, rows).items()}
    a, b = re.match(r"at (\S+) or (\S+), 12:30:45, std::vector, a::b$", got[1]).groups()
    assert re.fullmatch(r"([0-9a-f]{4}:){7}[0-9a-f]{4}", a) and a != rows[0][1].split()[1] and re.fullmatch(r"[0-9a-f]{4}::[0-9a-f]", b)
    rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    de, gb, wrong = re.match(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\d[A-Z]{4}\d{14}); (DE\d{20})\.$", got[2]).groups()
    assert rest(de.replace(" ", "")) == 1 == rest(gb) and rest(wrong) != 1 and "3704" not in de[5:9] and "WEST" not in gb


def test_megabyte_runs_of_every_kind(spark):
    n = 1 << 20
    runs = ["x@" + "a." * (n // 2) + "com", "a" * n + "@b.c", "x@" + "y" * n, "x@" + "a-" * (n // 2) + ".de", "1" * n, "+1" + " 23" * (n // 3), "(12) " * (n // 5), "1." * (n // 2), "f" * n, "a:" * (n // 2), "::" * (n // 2),
            "DE89" + " 1234" * (n // 5), "DE89" + "A" * n, "Mary " + "M" + "i" * n, "MARY " + "M" * n, "Mary Miller " * (n // 12), "4111 " * (n // 5), "1-" * (n // 2)]
    got = run(spark, list(enumerate(runs)))
    assert len(got) == len(runs) and got[2].text == runs[2] and "Miller" not in got[15].text


def test_null_ids_draw_again_as_others(spark, monkeypatch):
    small = lambda h, place, below: F.pmod(F.conv(F.substring(h, place, 12), 16, 10).cast("long"), F.lit(3))
    monkeypatch.setattr(pii, "_number", small)
    df = spark.createDataFrame([(None, f"host 10.0.0.{i + 1}") for i in range(30)], "doc_id long, text string")
    got = [r.text for r in pii.replace(df, KEY).collect()]
    assert len(set(got)) == 30
