"""Curated evidence and contacts: strict checks of every row, then the policy that a conclusion must meet.

A faulty row stops no other: its faults are named beside it, and it never gets
a conclusion.  Records are checked inside their candidate's array, so the only
shuffles are the count of tax numbers and the join with reconciliation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

RECORD = (
    "struct<evidence_type:string,source_name:string,source_url:string,source_record_id:string,source_authority:string,evidence_status:string,verification_strength:string,"
    "role_assertion:string,target_product_support:string,product_scope:array<string>,asserted_okpd2_codes:array<string>,evidence_date:string,valid_until:string,retrieved_at:string,notes:string>"
)
CANDIDATE = (
    "struct<supplier_inn:string,canonical_name:string,aliases:array<string>,market_role:string,verification_status:string,overall_strength:string,target_product_match:string,"
    f"exact_okpd2_asserted_by_source:boolean,verification_reason_codes:array<string>,review_reasons:array<string>,notes:string,evidence_records:array<{RECORD}>>"
)
_FIELD = "struct<value:string,source_url:string,source_authority:string,checked_at:string,address_type:string>"
CONTACT = f"struct<supplier_inn:string,company_name:string,content_currency:string,fields:struct<website:{_FIELD},email:{_FIELD},phone:{_FIELD},address:{_FIELD}>>"

#: The words that a candidate, a record and a contact may use.
ALLOWED = {
    "market_role": "MANUFACTURER MANUFACTURER_ASSERTED_BY_DECLARATION UNKNOWN",
    "verification_status": "UNVERIFIED UNDER_REVIEW VERIFIED",
    "overall_strength": "NONE WEAK MODERATE STRONG",
    "target_product_match": "DIRECT_PRODUCT_TEXT HISTORICAL_DIRECT_PRODUCT_TEXT UNKNOWN",
}
RECORD_ALLOWED = {
    "evidence_type": "CONFORMITY_DECLARATION LEGAL_IDENTITY FIRST_PARTY_WEBSITE CURRENT_PRODUCT_LISTING BUSINESS_PROFILE",
    "evidence_status": "ACTIVE SUSPENDED TERMINATED UNKNOWN",
    "verification_strength": "NONE WEAK MODERATE STRONG",
    "source_authority": "REGULATORY_REGISTRY_MIRROR_WITH_FGIS_ROSACCREDITATION_SOURCE FNS_EGRUL_DERIVED FIRST_PARTY RETAIL_SECONDARY SECONDARY_BUSINESS_PROFILE",
    "role_assertion": "MANUFACTURER_AND_APPLICANT ACTIVE_LEGAL_ENTITY DAIRY_PRODUCER ACTIVE_DAIRY_MANUFACTURER MANUFACTURER_NAMED_ON_PRODUCT_LISTING MAIN_OKVED_56_10 DAIRY_MANUFACTURER",
    "target_product_support": "DIRECT RELATED NONE",
}
RENAMED = "LEGAL_NAME_CHANGED_RECENTLY_ALIAS_PRESERVED"
#: Review reasons that do not stand in the way of a verified conclusion.
NOT_BLOCKING = (RENAMED, "NO_CURRENT_REGISTRY_DECLARATION_LOCATED_IN_THIS_RESEARCH_PASS")
AUTHORITIES = "FIRST_PARTY FNS_EGRUL_DERIVED_REGISTRY REGULATORY_REGISTRY".split()
ADDRESS_TYPES = "PUBLISHED_COMPANY_ADDRESS REGISTERED_LEGAL_ADDRESS".split()
CURRENCY = "CURRENT UNDATED OUTDATED".split()
FRESH_DAYS = 180

_HTTP = r"(?i)^https?://(?:[^/?#@\s]*@)?[^/?#@:\s]+"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"


def _true(c: Column) -> Column:
    """Null counts as no."""
    return F.coalesce(c, F.lit(False))


def _listed(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in their order."""
    return F.array_compact(F.array(*[F.when(_true(broken), name) for name, broken in rules.items()]))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _strings_bad(c: Column) -> Column:
    return _true(F.exists(c, _blank))


def _codes_bad(c: Column) -> Column:
    return _true(F.exists(c, lambda x: x.isNull() | ~x.rlike(r"^[A-Z][A-Z0-9_]*$"))) | _true(F.size(F.array_distinct(c)) < F.size(c))


def _date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def _instant(c: Column) -> Column:
    return F.when(c.rlike(_ZONED), c.try_cast("timestamp"))


def record_faults(e: Column, checked_at: Column) -> Column:
    """Faults of one evidence record.  Dates are whole ISO dates or absent;
    nothing may be dated after the seed was checked, and what is called active may not have run out by then."""
    dated, until, got, day = _date(e["evidence_date"]), _date(e["valid_until"]), _instant(e["retrieved_at"]), F.to_date(checked_at)
    rules = {name: ~_true(e[name].isin(words.split())) for name, words in RECORD_ALLOWED.items()}
    rules |= {
        "source_name": _blank(e["source_name"]),
        "source_url": F.trim(e["source_url"]) == "",
        "source_record_id": (F.trim(e["source_record_id"]) == "") | ((e["evidence_type"] == "CONFORMITY_DECLARATION") & e["source_record_id"].isNull()),
        "product_scope": _strings_bad(e["product_scope"]),
        "asserted_okpd2_codes": _true(F.exists(e["asserted_okpd2_codes"], lambda c: _blank(c) | scalars.okpd2(c)["flag"].isNotNull())),
        "evidence_date": (e["evidence_date"].isNotNull() & dated.isNull()) | (dated > day),
        "valid_until": (e["valid_until"].isNotNull() & until.isNull()) | (until < dated) | ((e["evidence_status"] == "ACTIVE") & (until < day)),
        "retrieved_at": got.isNull() | (got > checked_at),
    }
    return _listed(rules)


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with ``_n``, how often their tax number occurs; null without one.
    Counted before the join, so a frequent number is no large group."""
    return rows.join(rows.groupBy("supplier_inn").agg(F.count("*").alias("_n")), "supplier_inn", "left")


def _records(c: str, test) -> Column:
    return _true(F.exists(F.col(c), lambda e: _true(test(e))))


def _usable(e: Column, kind: str) -> Column:
    """Active evidence of a kind behind an address that anybody can open."""
    return (e["evidence_status"] == "ACTIVE") & (e["evidence_type"] == kind) & e["source_url"].rlike(_HTTP)


def judged(candidates: DataFrame, reconciled: DataFrame) -> DataFrame:
    """One row per candidate with its conclusion, or with the faults that bar one.

    candidates: target_okpd2, checked_at (string) and the fields of ``CANDIDATE``;
    reconciled: supplier_inn, target_okpd2, reconciliation_status.  A verified
    conclusion stands on an active strong declaration that supports the product
    directly and names the maker, or on a strong legal identity together with a
    current listing that names it; reasons for review bar it unless they are
    harmless.  ``verification_status`` is null where ``faults`` has entries.
    A tax number that occurs twice is a fault of all its rows, as is one that
    reconciliation has not, has twice, or has for another code.
    """
    checked = _instant(F.col("checked_at"))
    rows = _counted(candidates).withColumn("_checked", checked)
    known = reconciled.groupBy("supplier_inn").agg(F.count("*").alias("_known"), F.first("target_okpd2").alias("_target"), F.first("reconciliation_status").alias("reconciliation_status"))
    rows = rows.join(known, "supplier_inn", "left")
    direct = F.col("target_product_match") == "DIRECT_PRODUCT_TEXT"
    declared = direct & _records("evidence_records", lambda e: _usable(e, "CONFORMITY_DECLARATION") & (e["verification_strength"] == "STRONG") & (e["role_assertion"] == "MANUFACTURER_AND_APPLICANT") & (e["target_product_support"] == "DIRECT"))
    legal = _records("evidence_records", lambda e: _usable(e, "LEGAL_IDENTITY") & (e["verification_strength"] == "STRONG"))
    named = lambda e: (e["role_assertion"] == "MANUFACTURER_NAMED_ON_PRODUCT_LISTING") & e["verification_strength"].isin("MODERATE", "STRONG") & (e["target_product_support"] == "DIRECT")
    joint = direct & legal & _records("evidence_records", lambda e: _usable(e, "CURRENT_PRODUCT_LISTING") & named(e))
    rows = rows.withColumns({"_declared": _true(declared), "_joint": _true(joint)})
    reasons = F.coalesce("review_reasons", F.array().cast("array<string>"))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    verified = F.col("verification_status") == "VERIFIED"
    exact = _records("evidence_records", lambda e: F.array_contains(e["asserted_okpd2_codes"], F.col("target_okpd2")))
    target = scalars.okpd2(F.col("target_okpd2"))
    rules = {name: ~_true(F.col(name).isin(words.split())) for name, words in ALLOWED.items()}
    rules |= {
        "target_okpd2": F.col("target_okpd2").isNull() | target["flag"].isNotNull(),
        "checked_at": F.col("_checked").isNull(),
        "supplier_inn": F.col("supplier_inn").isNull() | scalars.inn(F.col("supplier_inn"))["flag"].isNotNull(),
        "repeated supplier_inn": F.col("_n") > 1,
        "canonical_name": _blank(F.col("canonical_name")),
        "aliases": _strings_bad(aliases) | (F.size(F.array_distinct(aliases)) < F.size(aliases)),
        "exact_okpd2_asserted_by_source": F.col("exact_okpd2_asserted_by_source").isNull() | (F.col("exact_okpd2_asserted_by_source") != exact),
        "verification_reason_codes": _codes_bad(F.col("verification_reason_codes")),
        "review_reasons": _codes_bad(reasons),
        "evidence_records": F.col("evidence_records").isNull(),
        "not reconciled": ~_true(F.col("_known") == 1),
        "reconciled for another code": F.col("_target") != F.col("target_okpd2"),
        "renamed without aliases": F.array_contains(reasons, RENAMED) & (F.size(aliases) == 0),
        "verified under review": verified & (F.size(F.array_except(reasons, F.array(*map(F.lit, NOT_BLOCKING)))) > 0),
        "verified without evidence": verified & ~F.col("_declared") & ~F.col("_joint"),
        "verified on weak evidence": verified & F.col("overall_strength").isin("NONE", "WEAK"),
        "review without reasons": (F.col("verification_status") == "UNDER_REVIEW") & (F.size(reasons) == 0),
    }
    inner = F.transform(F.col("evidence_records"), lambda e, i: F.transform(record_faults(e, F.col("_checked")), lambda f: F.concat(F.lit("record "), i.cast("string"), F.lit(": "), f)))
    faults = F.concat(_listed(rules), F.coalesce(F.flatten(inner), F.array().cast("array<string>")))
    rows = rows.withColumn("faults", faults)
    clean = F.size("faults") == 0
    review, closed = F.col("verification_status") == "UNDER_REVIEW", F.col("verification_status") == "UNVERIFIED"
    basis = F.when(review, "REVIEW").when(closed, "NONE").when(F.col("_declared"), "DECLARATION").otherwise("IDENTITY_AND_LISTING")
    told = F.when(review, F.concat(F.lit("Kept for review: "), F.concat_ws(", ", reasons))).when(closed, "The evidence allows no conclusion")
    told = told.when(F.col("_declared"), "An active strong declaration supports the product and names the maker").otherwise("A legal identity and a current listing support the product together")
    told = F.concat(told, F.when(verified & ~F.col("exact_okpd2_asserted_by_source"), "; no source states the exact code").otherwise(""))
    return rows.select(
        "supplier_inn", F.col("canonical_name").alias("company_name"), aliases.alias("aliases"), "reconciliation_status", "market_role", F.when(clean, F.col("verification_status")).alias("verification_status"),
        F.col("overall_strength").alias("verification_strength"), "target_product_match", "exact_okpd2_asserted_by_source", reasons.alias("review_reasons"), F.when(clean, basis).alias("basis"), F.when(clean, told).alias("why"),
        F.coalesce(F.size("evidence_records"), F.lit(0)).alias("evidence_count"), F.coalesce(F.size(F.filter("evidence_records", lambda e: e["evidence_status"] == "ACTIVE")), F.lit(0)).alias("active_evidence_count"),
        "evidence_records", "faults",
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of every seed file below ``path``, one row each.  A field of
    another type than ``CANDIDATE`` states is null, and so a fault where it is required."""
    raw = spark.read.json(path, multiLine=True, schema=f"target_okpd2 string, checked_at string, candidates array<{CANDIDATE}>")
    return raw.select("target_okpd2", "checked_at", F.explode("candidates").alias("c")).select("target_okpd2", "checked_at", "c.*")


def contact_records(contacts: DataFrame, today) -> DataFrame:
    """Curated contacts with their freshness, or with their faults.

    contacts: the fields of ``CONTACT``.  Every field that is present needs its
    value, source, authority and time of the check.  Freshness: STALE where the
    page itself is outdated or the last check is over ``FRESH_DAYS`` old,
    UNKNOWN without fields or for an undated page, else FRESH; null with faults.
    """
    names = ("website", "email", "phone", "address")
    of = {n: F.col(f"fields.{n}") for n in names}

    def field(n: str) -> dict[str, Column]:
        f, here = of[n], of[n].isNotNull()
        shape = {"website": f["value"].rlike(r"^https?://[^\s/]+\.\S+$"), "email": f["value"].rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "address": f["address_type"].isin(ADDRESS_TYPES), "phone": F.lit(True)}[n]
        return {
            f"{n}: value": here & (_blank(f["value"]) | ~_true(shape)),
            f"{n}: source_url": here & ~_true(f["source_url"].rlike(r"^https?://[^\s/]+\.\S+$")),
            f"{n}: source_authority": here & ~_true(f["source_authority"].isin(AUTHORITIES)),
            f"{n}: checked_at": here & _instant(f["checked_at"]).isNull(),
        }

    rules = {"supplier_inn": ~_true(F.col("supplier_inn").rlike(r"^(\d{10}|\d{12})$")), "repeated supplier_inn": F.col("_n") > 1, "content_currency": ~_true(F.col("content_currency").isin(CURRENCY))}
    rules = reduce(lambda a, n: a | field(n), names, rules)
    last = F.array_max(F.array(*[_instant(of[n]["checked_at"]) for n in names]))
    primary = F.coalesce(*[of[n]["source_url"] for n in ("phone", "email", "address", "website")])
    state = F.when(last.isNull(), "UNKNOWN").when(F.col("content_currency") == "OUTDATED", "STALE").when(F.col("content_currency") == "UNDATED", "UNKNOWN")
    state = state.when(F.datediff(F.lit(today).cast("date"), F.to_date(last)) <= FRESH_DAYS, "FRESH").otherwise("STALE")
    rows = _counted(contacts).withColumn("faults", _listed(rules))
    clean = F.size("faults") == 0
    return rows.select("supplier_inn", "company_name", "content_currency", F.when(clean, last).alias("last_checked_at"), F.when(clean, primary).alias("primary_source"), F.when(clean, state).alias("freshness"), "fields", "faults")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contact records of every file below ``path``."""
    return spark.read.json(path, multiLine=True, schema=f"contacts array<{CONTACT}>").select(F.explode("contacts").alias("c")).select("c.*")
