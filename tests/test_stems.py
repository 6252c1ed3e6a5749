"""Stems against the published algorithm's known results, and retrieval by them."""

from datetime import date

from pyspark.sql import functions as F

from lotlight.functions import stems
from lotlight.operators import search

#: Words and their stems from the vocabulary that the algorithm's authors publish;
#: from "насос" on they follow by hand from the rules.
KNOWN = {
    "вагон": "вагон вагона вагоне вагонов вагоном вагоны",
    "важн": "важная важнее важнейшие важнейшими важно важного важное важной важном важному важную важны важные важный важным важных",
    "важност": "важности важностию важность важностью",
    "важнича": "важничал",
    "ваз": "вазах вазы",
    "вакс": "вакса",
    "вал": "вал",
    "валанда": "валандался",
    "валерианов": "валериановых",
    "валет": "валетами",
    "в": "в",
    "п": "п",
    "па": "па пай",
    "пав": "пава",
    "павел": "павел",
    "павильон": "павильон павильонам",
    "павлин": "павлиний павлиньи павлиньим",
    "павлович": "павлович",
    "павловн": "павловна павловне павловной павловну павловны",
    "павловц": "павловцы",
    "пагубн": "пагубная",
    "пада": "падает падай падал падала падать падаю падают падающего падающие",
    "падал": "падаль",
    "паден": "падение падением падении падений падения паденье паденья",
    "падет": "падет",
    "падут": "падут",
    "падуч": "падучая",
    "падчериц": "падчерица падчерицей",
    "падш": "падшая падшей падшему падший падшим падших падшую",
    "пазух": "пазухи пазуху",
    "пайк": "пайком",
    "пакет": "пакет пакетом пакеты",
    "пакост": "пакостей",
    "пакостн": "пакостно",
    "насос": "насос насоса насосы насосов насосами насосах",
    "центробежн": "центробежный центробежная центробежного центробежными",
    "сдела": "сделав сделавши сделавшись сделанный",
    "куплен": "купленного",
    "купл": "куплен",
    "elle": "elle",
    "4х5": "4х5",
    "": "",
}


def test_known_stems(spark):
    rows = [(w, s) for s, words in KNOWN.items() for w in (words.split() or [""])]
    assert len(rows) >= 100
    got = spark.createDataFrame(rows, "word string, stem string").withColumn("got", stems.stem(F.col("word"))).filter("got <> stem").collect()
    assert [(r["word"], r["got"], r["stem"]) for r in got] == []


def test_lexemes_of_defined_cases(spark):
    rows = [("насосы для насоса и вода",), ("для и",), ("",), (None,), ("ещё ёлки",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(stems.lexemes("t")).collect()]
    assert got == [["насос", "вод"], [], [], None, ["елк"]]


def test_retrieval_by_stems(spark):
    names = ["насос центробежный", "насосы вихревые", "кабель медный", "кабели для насосов"]
    items = spark.createDataFrame([(i, i, 1, date(2020, 1, 1), n, None) for i, n in enumerate(names)], "lot_id long, part long, line int, publish_date date, text string, code string")
    asked = spark.createDataFrame([("насосов",)], "key string")
    config = search.Config(max_df_ratio=0.9)
    found = {}
    for tokeniser in (search.tokens_of, stems.lexemes):
        catalogue = search.Catalogue.of(items, tokeniser)
        weights = catalogue.features(asked, "key", config)
        found[tokeniser] = {r["text"] for r in search.any_of(weights, catalogue, config).collect()}
    assert found[search.tokens_of] == {"кабели для насосов"}
    assert found[stems.lexemes] == {"насос центробежный", "насосы вихревые", "кабели для насосов"}
