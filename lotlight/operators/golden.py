"""Found websites and contacts scored against values that people established.

Expectations are never derived from what was found; coverage (of those with an
expectation) and precision (of what was returned) are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

KINDS = ("PHONE", "EMAIL")


def value_of(kind: Column, raw: Column) -> Column:
    """The form in which values are compared: a number's digits, a small address."""
    return F.when(kind == "PHONE", F.coalesce(scalars.phone(raw), F.regexp_replace(raw, r"\D", ""))).otherwise(F.lower(F.trim(raw)))


def website_verdicts(golden: DataFrame, found: DataFrame) -> DataFrame:
    """One verdict per golden supplier.

    golden: supplier_id, domains, same_domains (arrays, null is empty), one row
    each; found: supplier_id, website (null: none; at most one row each).
    """
    none = F.array().cast("array<string>")
    rows = golden.select("supplier_id", F.coalesce("domains", none).alias("domains"), F.coalesce("same_domains", none).alias("same")).join(found.select("supplier_id", "website"), "supplier_id", "left")
    domain = scalars.registrable_domain(scalars.host(F.col("website")))
    verdict = F.when(F.col("website").isNull(), F.when(F.size("domains") > 0, "MISSED").otherwise("CORRECT_NONE"))
    verdict = verdict.when(F.array_contains("domains", domain), "CORRECT").when(F.array_contains("same", domain), "SAME_COMPANY_UNVERIFIABLE").otherwise("WRONG_COMPANY")
    return rows.select("supplier_id", (F.size("domains") > 0).alias("eligible"), "website", verdict.alias("verdict"))


def value_verdicts(golden: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every returned value of golden suppliers: correct, a violation (a value
    that must not be shown), or unlisted.

    golden: as ``golden_values``: supplier_id, kind, value, acceptable (else
    forbidden), repeats and both at once allowed; contacts: supplier_id, kind,
    raw.  Values meet by an equality of supplier, kind and value.
    """
    known = golden.groupBy("supplier_id", "kind", "value").agg(F.bool_or("acceptable").alias("correct"), F.bool_or(~F.col("acceptable")).alias("violation"))
    rows = contacts.select("supplier_id", "kind", "raw", value_of(F.col("kind"), F.col("raw")).alias("value"))
    out = rows.join(known, ["supplier_id", "kind", "value"], "left").na.fill(False, ["correct", "violation"])
    return out.withColumn("unlisted", ~F.col("correct") & ~F.col("violation"))


def golden_values(golden: DataFrame) -> DataFrame:
    """Rows of golden suppliers' arrays: supplier_id, phones, bad_phones, emails, bad_emails, already in their compared form."""
    lists = [("PHONE", "phones", True), ("PHONE", "bad_phones", False), ("EMAIL", "emails", True), ("EMAIL", "bad_emails", False)]
    told = F.flatten(F.array(*[F.coalesce(F.transform(F.col(c), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"), F.lit(ok).alias("acceptable"))), F.array().cast("array<struct<kind:string,value:string,acceptable:boolean>>")) for k, c, ok in lists]))
    return golden.select("supplier_id", F.explode(told).alias("g")).select("supplier_id", "g.*")


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(100 * F.col(part) / F.col(whole), 1))


def scores(suppliers: DataFrame, websites: DataFrame, golden: DataFrame, values: DataFrame) -> DataFrame:
    """One row for websites and one for each kind of value: suppliers with an
    expectation, suppliers with a find, covered suppliers, values returned,
    correct, wrong (another company's, or forbidden) and unlisted (or the same
    company's), and the two percentages, null over nothing.
    suppliers: supplier_id of all golden ones; values of others don't count."""
    v = F.col("verdict")
    site = websites.agg(
        F.count_if("eligible").alias("eligible"), F.count("website").alias("found"), F.count_if(v == "CORRECT").alias("covered"), F.count("website").alias("returned"), F.count_if(v == "CORRECT").alias("correct"),
        F.count_if(v == "WRONG_COMPANY").alias("wrong"), F.count_if(v == "SAME_COMPANY_UNVERIFIABLE").alias("unlisted"),
    ).select(F.lit("WEBSITE").alias("kind"), "*")
    wanted = golden.filter("acceptable").select("supplier_id", "kind").distinct().withColumn("eligible", F.lit(True))
    got = values.join(suppliers.select("supplier_id"), "supplier_id", "left_semi").groupBy("supplier_id", "kind").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("correct", "violation", "unlisted")])
    per = wanted.join(got, ["supplier_id", "kind"], "full").groupBy("kind").agg(
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("n") > 0).alias("found"), F.count_if(F.col("eligible") & (F.col("correct") > 0)).alias("covered"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "returned"), ("correct", "correct"), ("violation", "wrong"), ("unlisted", "unlisted"))],
    )
    kinds = suppliers.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    out = site.unionByName(kinds.join(per, "kind", "left").na.fill(0))
    return out.withColumns({"coverage": _percent("covered", "eligible"), "precision": _percent("correct", "returned")})


def invented(contacts: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether each first-party value occurs in the page it is said to come from.

    contacts: supplier_id, kind, raw, source_type, source_url; pages: url, text,
    one row each.  Numbers are looked for without their country code among the
    page's digits.  ``present`` is null where the page is not to be had.
    """
    rows = contacts.filter("source_type = 'FIRST_PARTY'").join(pages.select(F.col("url").alias("source_url"), F.col("text").alias("_page")), "source_url", "left")
    value = value_of(F.col("kind"), F.col("raw"))
    here = F.when(F.col("kind") == "PHONE", F.contains(F.regexp_replace("_page", r"\D", ""), F.substring(value, 2, 1000))).otherwise(F.contains(F.lower(F.col("_page")), value))
    return rows.select("supplier_id", "kind", value.alias("value"), "source_url", here.alias("present"))
