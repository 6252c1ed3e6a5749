"""Resolving texts to categories of a taxonomy.

The taxonomy is a table of codes with titles and parents; its ancestors are
found by self-joins over a bounded depth.  A text is matched in order of
trust: an exact title, then title terms by their weight.  The decision is
RESOLVED, AMBIGUOUS or UNCERTAIN by the best score and its margin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import spread
from . import search


@dataclass(frozen=True)
class Rule:
    accept: float = 0.36
    margin: float = 0.18


def ancestors(codes: DataFrame, depth: int) -> DataFrame:
    """code and each ancestor with its distance, itself included."""
    level = codes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance"))
    out, up = level, codes.select(F.col("code").alias("ancestor"), "parent").filter("parent is not null")
    for d in range(1, depth):
        level = level.join(up, "ancestor").select("code", F.col("parent").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.unionByName(level)
    return out


def resolve(queries: DataFrame, titles: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """queries (query, text) against titles (code, title): the best code, its
    score, how it was found, and the decision.

    Equal texts are resolved once; a text's pairs with titles are formed in one
    task, and their number, known from the tokens, deals the texts over tasks."""
    key = lambda c: scalars.comparison_key(F.col(c))
    asked = queries.select("query", key("text").alias("key"))
    texts = asked.select("key").distinct()
    named = titles.withColumn("key", key("title"))
    exact = texts.join(named.select("key", "code"), "key").groupBy("key").agg(F.min("code").alias("exact_code"), F.count("*").alias("exact_codes"))
    terms = search.tokens(named.select("code", "key"), "code", "key")
    n = titles.count()
    weighted = search.with_idf(search.tokens(texts, "key", "key"), search.document_frequency(terms), n)
    pairs = weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    scored = search.text_scores(spread(weighted, pairs, "key"), terms, "key", "code").withColumn("text", F.round("text", 6))
    placed = search.top(scored, "key", [F.desc("text"), "code"], 2)
    best = placed.groupBy("key").agg(F.max(F.when(F.col("place") == 1, F.col("code"))).alias("term_code"), F.max(F.when(F.col("place") == 1, F.col("text"))).alias("score"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("text"))), F.lit(0.0)).alias("second"))
    both = asked.join(exact, "key", "left").join(best, "key", "left")
    one_title = F.col("exact_codes") == 1
    decision = (
        F.when(one_title, "RESOLVED").when(F.col("exact_codes") > 1, "AMBIGUOUS").when((F.col("score") >= rule.accept) & (F.col("score") - F.col("second") >= rule.margin), "RESOLVED").when(F.col("score") >= rule.accept, "AMBIGUOUS").otherwise("UNCERTAIN")
    )
    return both.select("query", F.coalesce("exact_code", "term_code").alias("code"), F.when(F.col("exact_codes") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.when(F.col("exact_codes") > 0, "exact").when(F.col("score").isNotNull(), "terms").otherwise("none").alias("found_by"), decision.alias("decision"))


def grid(scored: DataFrame, accepts: list[float], margins: list[float]) -> DataFrame:
    """Coverage and precision of every pair of thresholds; the grid is small
    and stated, and scores are first counted by their rounded values."""
    held = scored.groupBy(F.round("score", 2).alias("score"), F.round(F.col("score") - F.col("second"), 2).alias("gap"), "correct").agg(F.count("*").alias("n"))
    steps = held.withColumn("accept", F.explode(F.array(*[F.lit(a) for a in accepts]))).withColumn("margin", F.explode(F.array(*[F.lit(m) for m in margins])))
    taken = (F.col("score") >= F.col("accept")) & (F.col("gap") >= F.col("margin"))
    return steps.groupBy("accept", "margin").agg(F.sum("n").alias("cases"), F.coalesce(F.sum(F.when(taken, F.col("n"))), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(taken & F.col("correct"), F.col("n"))), F.lit(0)).alias("right"))
