"""Enrichment of supplier profiles: contacts, sites, merges, breakers, ages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags gone, entities decoded, white
    space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def contacts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct contacts of each text: kind, normalised value, domain."""
    found = F.concat(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(EMAIL), F.lit(0)), lambda e: F.struct(F.lit("EMAIL").alias("kind"), F.lower(e).alias("value"))),
        F.transform(F.regexp_extract_all(F.col(text), F.lit(PHONE), F.lit(0)), lambda p: F.struct(F.lit("PHONE").alias("kind"), F.regexp_replace(p, "[^0-9]", "").alias("value"))),
    )
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(found)).alias("c")).select(key, "c.kind", "c.value")
    return rows.withColumn("domain", F.when(F.col("kind") == "EMAIL", scalars.registrable_domain(F.substring_index("value", "@", -1))))


def best_sites(pages: DataFrame, limit: int) -> DataFrame:
    """The shortest address of each domain, and the domains with most pages."""
    h = pages.withColumn("host", scalars.host(F.col("url"))).filter("host <> ''").withColumn("domain", scalars.registrable_domain(F.col("host")))
    order = Window.partitionBy("domain").orderBy(F.length("url"), "url")
    best = h.withColumn("place", F.row_number().over(order)).withColumn("pages", F.count("*").over(Window.partitionBy("domain"))).filter("place = 1")
    return best.orderBy(F.desc("pages"), "domain").limit(limit).select("domain", "url", "pages")


def error_islands(log: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 2) -> DataFrame:
    """Runs of consecutive failures per key, and where each opens the breaker:
    at its ``threshold``-th failure."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("_bad", failed).withColumn("_n", F.row_number().over(w))
    bad = rows.filter("_bad").withColumn("island", F.col("_n") - F.row_number().over(w))
    nth = bad.withColumn("_at", F.row_number().over(Window.partitionBy(key, "island").orderBy(*order)))
    return nth.groupBy(key, "island").agg(F.count("*").alias("failures"), F.min(order[0]).alias("since"), F.max(F.when(F.col("_at") == threshold, F.col(order[0]))).alias("opened_at"))


def freshness(when: Column, today: date, days: int) -> Column:
    return F.when(when.isNull(), "UNKNOWN").when(F.datediff(F.lit(today), when) <= days, "FRESH").otherwise("STALE")


def reusable(status: Column, retryable: Column, age_hours: Column, ttl_days: int = 30, retry_hours: int = 24, busy_hours: float = 0.25) -> Column:
    """Whether a stored profile is returned instead of a new run."""
    recent = age_hours < retry_hours
    return F.coalesce(
        F.when((status == "PARTIAL") & retryable, recent).when(status.isin("COMPLETE", "PARTIAL"), age_hours <= ttl_days * 24).when(status == "FAILED", ~retryable | recent).when(status == "IN_PROGRESS", age_hours < busy_hours),
        F.lit(False),
    )


def merge_refresh(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A refresh that never loses data: new values replace old ones where
    there are any; what only the old run had is kept and named."""
    a = old.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    b = new.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_ran"))
    both = a.join(b, key, "full")
    kept = [F.when(F.col("_ran") & F.col(f"_new_{f}").isNull() & F.col(f"_old_{f}").isNotNull(), f) for f in fields]
    state = F.when(F.col("_ran").isNull(), "UNTOUCHED").when(F.size(F.array_compact(F.array(*kept))) > 0, "KEPT").otherwise("REPLACED")
    return both.select(key, *[F.coalesce(f"_new_{f}", f"_old_{f}").alias(f) for f in fields], state.alias("refresh"), F.concat_ws("|", F.array_compact(F.array(*kept))).alias("kept_fields"))


def role(code: Column) -> Column:
    """Inferred role by the activity's division; never verified."""
    division = F.split(code, r"\.")[0].try_cast("int")
    return F.when(division.between(10, 33), "MANUFACTURER").when(division == 46, "DISTRIBUTOR")


def merge_identity(rows: DataFrame) -> DataFrame:
    """Primary identity wins, the mirror fills gaps; different registration
    numbers reject the mirror."""
    conflict = F.coalesce(F.col("primary_ogrn") != F.col("mirror_ogrn"), F.lit(False))
    pick = lambda f: F.coalesce(f"primary_{f}", F.when(~conflict, F.col(f"mirror_{f}")))
    return rows.select("key", pick("ogrn").alias("ogrn"), pick("name").alias("name"), conflict.alias("conflict"))


def run_state(events: DataFrame, key: str, kind: str) -> DataFrame:
    """COMPLETE, PARTIAL or FAILED from the outcomes of a profile's runs."""
    ok, bad = F.count_if(F.col(kind) == "purchase"), F.count_if(F.col(kind) == "error")
    held = events.groupBy(key).agg(F.count("*").alias("runs"), ok.alias("found"), bad.alias("errors"))
    status = F.when((F.col("found") > 0) & (F.col("errors") == 0), "COMPLETE").when(F.col("found") > 0, "PARTIAL").otherwise("FAILED")
    return held.withColumn("status", status).withColumn("retryable", (F.col("status") != "COMPLETE") & (F.col("errors") > 0))


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule (SQL conditions that should hold); a
    null outcome breaks it."""
    one = rows.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")
