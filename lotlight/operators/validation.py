"""Category codes that came with an item, held against the item's own text.

Only items and their tokens move: tokens meet the tokens known for each code by
equality of code and token, and codes meet the official list by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

STATUSES = ("SUPPLIED_ALIGNED", "SUPPLIED_UNVERIFIED", "RESOLVED_FROM_TEXT", "UNRESOLVED")


def validated(items: DataFrame, official: DataFrame, known: DataFrame, resolved: DataFrame) -> DataFrame:
    """The category of every item: its own code where that is official and not
    contradicted, else the one its text resolves to.

    items: item (unique), code (raw, may be null), tokens (array); official:
    code, name (repeats count once; without a name a code is not official);
    known: code, token, of historical items; resolved: item, state,
    ranking_code, suggestions (array of codes, best first), one row each.

    SUPPLIED_ALIGNED: a token known for the code, or a suggestion in its group
    or above or below it; RESOLVED_FROM_TEXT: the text resolves, and the code is
    of another class, malformed, not official or missing; SUPPLIED_UNVERIFIED:
    an official code that the text neither confirms nor contradicts;
    UNRESOLVED: no code.  ``shared`` holds up to four confirming tokens in order.
    An item without a resolution has not resolved.
    """
    parsed = scalars.okpd2(F.col("code"))
    listed = official.filter("name is not null and trim(name) <> ''").select(F.col("code").alias("given")).distinct().withColumn("_official", F.lit(True))
    rows = items.select("item", F.when(parsed["flag"].isNull(), F.trim("code")).alias("given"), "tokens").join(listed, "given", "left")
    told = rows.filter("_official").select("item", "given", F.explode(F.array_distinct("tokens")).alias("token"))
    # a token of four suffices, and an item's tokens are few: the lists are bounded by its text
    shared = told.join(known.select(F.col("code").alias("given"), "token").distinct(), ["given", "token"], "left_semi").groupBy("item").agg(F.slice(F.sort_array(F.collect_set("token")), 1, 4).alias("shared"))
    rows = rows.drop("tokens").join(shared, "item", "left").join(resolved.select("item", "state", "ranking_code", "suggestions"), "item", "left")
    given = F.col("given")
    under = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    near = F.coalesce(F.exists("suggestions", lambda s: (s == given) | (F.substring(s, 1, 5) == F.substring(given, 1, 5)) | under(s, given) | under(given, s)), F.lit(False))
    text = F.coalesce((F.col("state") == "RESOLVED") & F.col("ranking_code").isNotNull(), F.lit(False))
    own = F.col("_official").isNotNull()
    status = F.when(own & (F.col("shared").isNotNull() | near), "SUPPLIED_ALIGNED").when(text & (~own | (F.substring("ranking_code", 1, 2) != F.substring(given, 1, 2))), "RESOLVED_FROM_TEXT")
    status = status.when(own, "SUPPLIED_UNVERIFIED").otherwise("UNRESOLVED")
    out = rows.withColumn("status", status)
    code = F.when(F.col("status") == "RESOLVED_FROM_TEXT", F.col("ranking_code")).when(F.col("status") != "UNRESOLVED", given)
    return out.select("item", code.alias("code"), "status", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))
