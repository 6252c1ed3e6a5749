"""URL filter: list rules, then logistic regression on character n-grams.

The model is trained with Spark's own logistic regression on a small table of
labelled URLs; features are n-grams of host and path, hashed into a fixed
number of places.  Host, path, rules, features and scores are SQL expressions
and JVM code; no Python runs per row.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and no rule, and the model allows it; repeated rows are judged alike; other
columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 1 << 14
SIZES = (3, 4, 5)

#: Fixed values: (host, path, verdict) of the list rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Host names of the labelled table, written for it; none comes from the tables that are judged.
BLOCKED_WORDS = """royal-casino casinopalace online-casino casino-bonus vegascasino live-casino-games megacasino24 pokerstarz videopoker-room texas-poker freepoker slotmachines super-slots slots-jackpot
lucky-jackpot sportbets betsonline bets-today freebet-bonus bet-and-win betting-odds bookmaker-bonus roulette-royal bingo-bonus big-win-prizes free-prizes win-a-phone lottery-winners claim-your-prize free-gift-cards
discount-pills diet-pills pillshop24 bluepills buy-viagra viagra-online genericviagra cialis-pharmacy cheap-meds online-pharma-rx no-prescription-meds steroids-shop weightloss-pills cheapcialis
adserver ads-network clickads popads adtracker track-clicks pixel-track banner-ads adsdelivery trackstats ad-exchange popunder-ads click-tracker doubleads
spamlinks seo-spam link-farm linkfarm-seo backlinks-cheap buy-backlinks mail-spam content-farm spam-bots article-spinner
adultcams adult-dating adult-videos xxx-movies xxxtube freexxx pornvideos porn-hd teenporn sex-chat livesex sexcams hot-escorts nude-girls adultfriends erotic-cams milf-xxx
payday-loans fastloans cheap-loans bad-credit-loans instant-cash-loan quick-cash crypto-doubler easy-money-fast get-rich-now forex-signals-pro
replica-watches fake-rolex cheap-handbags warez-crack cracked-apks keygen-download free-torrents serial-keys malware-drop trojan-host phish-login verify-account-login secure-login-update""".split()
ALLOWED_WORDS = """library citylibrary museum national-museum weather weather-today gardening kitchen-garden recipes easy-recipes university technical-university research research-notes archive archives-nationales
journal journal-of-biology history local-history science popular-science travel-notes slow-travel city-news daily-news morningpost thedailyherald tribune gazette lemonde-diplo zeitung abendblatt nachrichten elpais-cultura noticias
open-data statistics-office census parliament ministry-of-health cityhall townhall-services hospital children-hospital health-advice nursing dentist pharmacists-association music-school orchestra jazzclub theatre opera-house
bookshelf bookshop second-hand-books mountain-club alpine-hut river-walks hiking-trails cycling-routes bike-repair track-and-field athletics football-club chess-club winter-sports rowing
train-times railway bus-timetable airport-info harbour maps maps-and-routes geodata language-lab dictionary grammar translation photo-diary photography camera-reviews film-review cinema painting
farmers-market organic-farm dairy-farm beekeeping winery bakery coffee-roasters restaurant-guide hotel-sonne campsite adult-education adult-learning evening-classes kindergarten primary-school highschool
software-docs developer-handbook python-tutorial linux-wiki opensource compiler-notes database-journal mathematics physics-forum chemistry astronomy geology botany birdwatching wildlife
credit-union savings-bank insurance-guide tax-office law-review courts freelance-network freedom-of-press winter-garden windows-and-doors alphabets tablets-for-schools advice-line adriatic-coast addis-report
toys knitting woodworking furniture carpentry plumbing electricians architecture interior-design renewable-energy solar-power water-board recycling climate-lab oceanography
stmartin-parish cathedral choir genealogy family-tree memories letters essays poetry shortstories philosophy podcast radio-nord stadtwerke gemeinde universidad biblioteca ayuntamiento mairie musee-lyon jardin""".split()
FRONTS = ("", "www.", "news.", "shop.", "static.")
TAILS = ("com", "org", "net", "info", "eu", "de", "fr", "es", "co.uk", "io", "ch")
PATHS = ("", "/", "/index.html", "/about", "/2021/05/18/some-title", "/a/b/c", "/item.php?id=77", "/en/start", "/category/new/page/3", "/go?to=1&from=2", "/x91k2", "/files/list.htm#end", "/contact/", "/de/seite")


def words() -> list[tuple[str, float]]:
    """The host names of the labelled table, and 1 for block."""
    return [(w, 1.0) for w in BLOCKED_WORDS] + [(w, 0.0) for w in ALLOWED_WORDS]


def urls(names: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Four URLs of each host name; front, tail and path don't depend on the label."""
    rows = []
    for word, label in names:
        for j in range(4):
            k = crc32(f"{word} {j}".encode())
            rows.append((f"{('http', 'https')[k % 2]}://{FRONTS[k // 2 % 5]}{word}.{TAILS[k // 10 % 11]}{PATHS[k // 110 % 14]}", label))
    return rows


def labelled(spark: SparkSession) -> DataFrame:
    """url and label (1: block) of the training table."""
    return spark.createDataFrame(urls(words()), "url string, label double")


def host(url: str = "url") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null if none."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with its part."""

    def of(text: Column, n: int, mark: str) -> Column:
        last = F.length(text) - (n - 1)
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.concat(*[of(t, n, m) for t, m in ((F.concat(F.lit("^"), host, F.lit("$")), "h"), (path, "p")) for n in SIZES])


def _features(urls: DataFrame) -> DataFrame:
    split = urls.withColumn("host", host()).withColumn("path", path())
    tokens = split.withColumn("_grams", grams(F.col("host"), F.col("path")))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=PLACES, binary=True).transform(tokens).drop("_grams")


def train(table: DataFrame) -> LogisticRegressionModel:
    """Fit on a table of url and label; its size bounds the work."""
    rows = _features(table).coalesce(1)
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.01, maxIter=50, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted").fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of ``keep``, host, path, rule, score and verdict."""
    scored = model.transform(_features(pages.select(*keep, "url")))
    name, by_rule = rule(F.col("host"), F.col("path"))
    score = F.when(F.col("host") == "", F.lit(0.0)).otherwise(vector_to_array("_probability")[1])
    own = F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*keep, "host", "path", name.alias("rule"), F.coalesce(by_rule, own).alias("verdict"), score.alias("score"))
