from datetime import date

import pytest
from pyspark.sql import functions as F

from lotlight.functions import scalars, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [
    (None, (None, "unknown", None, "MISSING_INN")), (" 7707083893 ", ("7707083893", "legal_entity", "77", None)), ("7707083894", ("7707083894", "legal_entity", "77", "INVALID_INN_CHECKSUM")),
    ("500100732259", ("500100732259", "individual_entrepreneur", "50", None)), ("77O7083893", ("77O7083893", "unknown", None, "INVALID_INN_FORMAT")), ("123456789", ("123456789", "unknown", None, "INVALID_INN_FORMAT")),
])
def test_inn(spark, raw, want):
    assert tuple(one(spark, scalars.inn(F.lit(raw).cast("string")))) == want


@pytest.mark.parametrize("raw,flag", [("", "MISSING_KPP"), ("770701001", None), ("7707AB001", None), ("77070100", "INVALID_KPP_FORMAT")])
def test_kpp(spark, raw, flag):
    assert one(spark, scalars.kpp(F.lit(raw))).flag == flag


@pytest.mark.parametrize("raw,want", [
    ("33.12.1", ("33.12.1", 3, "C", "33", "33.1", "33.12", "33.12.1", None, None)), ("10.51.11.141", ("10.51.11.141", 4, "C", "10", "10.5", "10.51", "10.51.1", "10.51.11", None)),
    ("22.19.6O.119", (None,) * 8 + ("INVALID_OKPD2",)), ("04.11", (None,) * 8 + ("INVALID_OKPD2",)), (" ", (None,) * 8 + ("MISSING_OKPD2",)), ("25", ("25", 1, "C", "25", None, None, None, None, None)),
])
def test_okpd2(spark, raw, want):
    assert tuple(one(spark, scalars.okpd2(F.lit(raw)))) == want


@pytest.mark.parametrize("a,b,want", [
    ("10.51.11.141", "10.51.11.141", 1.0), ("10.51.11", "10.51.11.141", 0.8), ("10.51.11.141", "10.51.11.142", 0.7), ("10.51.11.141", "10.51.12.141", 0.55), ("10.51.11.141", "10.51.30.141", 0.4),
    ("10.51.11.141", "10.52.11.141", 0.25), ("10.51.11.141", "10.61.11.141", 0.1), ("10.51.11.141", "11.51.11.141", 0.0), ("10", "10.61.11.141", 0.8), ("", "10", 0.0),
])
def test_okpd2_similarity(spark, a, b, want):
    row = spark.range(1).select(scalars.okpd2(F.lit(a)).alias("a"), scalars.okpd2(F.lit(b)).alias("b"))
    assert row.select(scalars.okpd2_similarity(F.col("a"), F.col("b")).alias("s")).first().s == want


def test_small_scalars(spark):
    assert one(spark, scalars.price(F.lit("71985.00"))).value == 71985 and one(spark, scalars.price(F.lit("0"))).flag == "ZERO_START_PRICE" and one(spark, scalars.price(F.lit("-1"))).structural
    assert one(spark, scalars.iso_date(F.lit("2024-02-29"))) == date(2024, 2, 29) and one(spark, scalars.iso_date(F.lit("2023-02-29"))) is None and one(spark, scalars.iso_date(F.lit("20240229"))) is None
    assert one(spark, scalars.strict_bool(F.lit(" true "))) is True and one(spark, scalars.strict_bool(F.lit("True"))) is None
    assert one(spark, scalars.platform(F.lit("ЭМ"))) == "EM" and one(spark, scalars.platform(F.lit("x"))) is None
    assert one(spark, scalars.comparison_key(F.lit("Ёлка, №5!"))) == "елка 5"
    assert one(spark, scalars.name_variant(F.lit("Елка 5"), F.lit("ёлка №5"))) is None
    assert one(spark, scalars.tech_tokens(F.lit('ноутбук a515-57-50r7 16гб "4103dw" 12345 a515-57-50r7'))) == ["a515-57-50r7", "4103dw"]
    assert one(spark, scalars.phone(F.lit("8 (812) 555-35-35"))) == "78125553535" and one(spark, scalars.phone(F.lit("123"))) is None
    assert one(spark, scalars.registrable_domain(F.lit("a.b.spb.ru"))) == "b.spb.ru" and one(spark, scalars.host(F.lit("https://u@www.X.ru:80/p"))) == "x.ru"
    assert one(spark, scalars.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.lit("a"))) == str(__import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "a"))
    assert one(spark, scalars.calibrated(F.lit(0.99))) == 1.0 and one(spark, scalars.calibrated(F.lit(0.5))) == 0.0


FORMS = [
    (None, None), (" \t", None), ('""', None), ("Кабель ВВГ-3*2,5 (бухта 100 м)", "кабель ввг-3x2,5 бухта 100 м"), ("Насос 1.1 кВт; 220В!", "насос 1.1 квт 220в"), ("8 * 10 см", "8x10 см"), ("7 х9", "7 х9"),
    ("пакет «Май» 50%-ный", "пакет май 50% ный"), ('диск 3.5" и 2,5"', 'диск 3.5" и 2,5"'), ('"Ладога" 12" экран', 'ладога 12" экран'), ("плитка 30×30×0,8", "плитка 30x30x0,8"), ("вес ~5кг.", "вес 5кг"), ("а+б/в-г", "а+б/в-г"),
    ("-5 +7 /8", "5 7 8"), ("10%% 5 %", "10% 5"), ("Ёршик ЁЖ", "ершик еж"), ("к²м² пол м³", "к м2 пол м3"), ("x₂ H₂O", "x h o"), ("`цитата' ‘один’", "цитата один"), ("тире – и — и ‑", "тире и и"), ("1,2,3.4.", "1,2,3.4"),
    ("5,5 , 5", "5,5 5"), ("*** звезда **", "звезда"), ("3х4х5х6", "3x4x5x6"), ("7 x 8 х 9 * 10", "7x8x9x10"), ('12""', '12"'), ('"5"', "5"), ("A\xadB\u200bC", "abc"), ("tab\tновая\nстрока", "tab новая строка"), ("№12/б", "12/б"),
    ("ГОСТ 12.3.4-88", "гост 12.3.4-88"), ("r-", "r"), ("100%хлопок", "100%хлопок"), ("2*", "2"), ("е\u0308лочка", "елочка"),
]


def test_search_form_and_idempotence(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(FORMS)], "i int, raw string")
    got = text.normalize(text.normalize(df, "raw", "once"), "once", "twice").orderBy("i").collect()
    assert [r.once for r in got] == [want for _, want in FORMS]
    assert [r.twice for r in got] == [want for _, want in FORMS]


def test_code_relation(spark):
    rows = spark.createDataFrame([("10.51.11", "10.51.11", 3), ("10.51", "10.51.3", 2), ("10", "10.51", 1), ("10.5", "11.5", 0)], "a string, b string, want int")
    got = rows.select("want", scalars.code_relation(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == r.want for r in got)
    assert [one(spark, scalars.alignment(F.lit(k))) for k in (3, 2, 1, 0)] == ["ALIGNED", "ALIGNED", "UNCERTAIN", "MISMATCH"]
    assert one(spark, scalars.type_marker(F.lit("насос тип 3, тип 4"))) == "тип 3" and one(spark, scalars.type_marker(F.lit("тип12 х"))) == "тип 12" and one(spark, scalars.type_marker(F.lit("тип 1234 подтип 5"))) is None
