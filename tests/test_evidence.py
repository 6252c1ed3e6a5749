"""Curated evidence: strict checks and the policy, case by case."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lotlight.operators import evidence

GOOD = {"evidence_type": "CONFORMITY_DECLARATION", "source_name": "register", "source_url": "https://register.example/1", "source_record_id": "D-1", "source_authority": "FIRST_PARTY", "evidence_status": "ACTIVE",
        "verification_strength": "STRONG", "role_assertion": "MANUFACTURER_AND_APPLICANT", "target_product_support": "DIRECT", "product_scope": ["milk"], "asserted_okpd2_codes": ["10.51.11"],
        "evidence_date": "2024-01-10", "valid_until": "2027-01-10", "retrieved_at": "2025-02-01T10:00:00+03:00", "notes": None}
LEGAL = GOOD | {"evidence_type": "LEGAL_IDENTITY", "role_assertion": "ACTIVE_LEGAL_ENTITY", "asserted_okpd2_codes": []}
LISTING = GOOD | {"evidence_type": "CURRENT_PRODUCT_LISTING", "role_assertion": "MANUFACTURER_NAMED_ON_PRODUCT_LISTING", "verification_strength": "MODERATE", "asserted_okpd2_codes": []}


def tax_number(n):
    nine = f"77{n:07d}"
    return nine + str(sum(int(a) * b for a, b in zip(nine, (2, 4, 10, 3, 5, 9, 4, 6, 8))) % 11 % 10)


def candidate(n, records=(GOOD,), **more):
    exact = any("10.51.11" in (r["asserted_okpd2_codes"] or []) for r in records)
    return {"supplier_inn": tax_number(n), "canonical_name": f"Maker {n}", "aliases": ["Old name"], "market_role": "MANUFACTURER", "verification_status": "VERIFIED", "overall_strength": "STRONG",
            "target_product_match": "DIRECT_PRODUCT_TEXT", "exact_okpd2_asserted_by_source": exact, "verification_reason_codes": [], "review_reasons": [], "notes": None, "evidence_records": list(records)} | more


CASES = [
    (candidate(1), "DECLARATION", []),
    (candidate(2, [LEGAL, LISTING]), "IDENTITY_AND_LISTING", []),
    (candidate(3, [LEGAL]), None, ["verified without evidence"]),
    (candidate(4, [GOOD | {"evidence_status": "SUSPENDED"}]), None, ["verified without evidence"]),
    (candidate(5, [GOOD | {"source_url": "ftp://register.example"}]), None, ["verified without evidence"]),
    (candidate(6, target_product_match="HISTORICAL_DIRECT_PRODUCT_TEXT"), None, ["verified without evidence"]),
    (candidate(7, review_reasons=["ROLE_UNCLEAR"]), None, ["verified under review"]),
    (candidate(8, review_reasons=[evidence.RENAMED]), "DECLARATION", []),
    (candidate(9, review_reasons=[evidence.RENAMED], aliases=[]), None, ["renamed without aliases"]),
    (candidate(10, overall_strength="WEAK"), None, ["verified on weak evidence"]),
    (candidate(11, verification_status="UNDER_REVIEW"), None, ["review without reasons"]),
    (candidate(12, verification_status="UNDER_REVIEW", review_reasons=["ROLE_UNCLEAR"]), "REVIEW", []),
    (candidate(13, [], verification_status="UNVERIFIED"), "NONE", []),
    (candidate(14, exact_okpd2_asserted_by_source=False), None, ["exact_okpd2_asserted_by_source"]),
    (candidate(15, [GOOD | {"valid_until": "2025-01-01"}]), None, ["record 0: valid_until"]),
    (candidate(16, [GOOD, GOOD | {"evidence_date": "2025-13-01"}]), None, ["record 1: evidence_date"]),
    (candidate(17, [GOOD | {"retrieved_at": "2025-02-01T10:00:00"}]), None, ["record 0: retrieved_at"]),
    (candidate(18, [GOOD | {"source_record_id": None}]), None, ["record 0: source_record_id"]),
    (candidate(19, [GOOD | {"evidence_type": "RUMOUR", "asserted_okpd2_codes": None}]), None, ["verified without evidence", "record 0: evidence_type"]),
    (candidate(20, review_reasons=["lower case"], verification_status="UNDER_REVIEW"), None, ["review_reasons"]),
    (candidate(21, aliases=["A", "A"]), None, ["aliases"]),
    (candidate(22, supplier_inn="7700000001"), None, ["supplier_inn", "not reconciled"]),
    (candidate(23, evidence_records=None, verification_status="UNVERIFIED", exact_okpd2_asserted_by_source=False), None, ["evidence_records"]),
    (candidate(25), None, ["not reconciled"]),
    (candidate(26), None, ["reconciled for another code"]),
]


def test_policy(spark, tmp_path):
    twice = [candidate(24), candidate(24, aliases=[])]
    seed = {"target_okpd2": "10.51.11", "checked_at": "2025-03-01T00:00:00+00:00", "candidates": [c for c, _, _ in CASES] + twice}
    (tmp_path / "one_evidence_seed.json").write_text(json.dumps(seed), encoding="utf-8")
    rows = evidence.read_candidates(spark, str(tmp_path))
    known = spark.createDataFrame([(tax_number(n), "10.51.12" if n == 26 else "10.51.11", "EXTERNAL_NEW") for n in range(1, 27) if n != 25], "supplier_inn string, target_okpd2 string, reconciliation_status string")
    got = {}
    for r in evidence.judged(rows, known).collect():
        got.setdefault(r["company_name"], []).append(r)
    for c, basis, faults in CASES:
        (r,) = got[c["canonical_name"]]
        assert (r["basis"], r["faults"]) == (basis, faults), c["canonical_name"]
        assert (r["verification_status"] is None) == bool(faults)
        assert r["evidence_count"] == len(c["evidence_records"] or [])
    assert [r["faults"] for r in got["Maker 24"]] == [["repeated supplier_inn"]] * 2
    assert got["Maker 2"][0]["why"].endswith("; no source states the exact code") and ";" not in got["Maker 1"][0]["why"]
    assert evidence.judged(rows.limit(0), known).count() == 0


def test_every_null_is_a_fault_and_never_a_crash(spark):
    rows = spark.createDataFrame([(None, None, None)], f"target_okpd2 string, checked_at string, c {evidence.CANDIDATE}").select("target_okpd2", "checked_at", "c.*")
    holes = rows.withColumn("evidence_records", F.expr(f"array(cast(null as {evidence.RECORD}))"))
    known = rows.select("supplier_inn", "target_okpd2", F.lit("EXTERNAL_NEW").alias("reconciliation_status"))
    for r in evidence.judged(rows.unionByName(holes), known).collect():
        assert r["verification_status"] is None and {"supplier_inn", "checked_at", "canonical_name", "market_role"} <= set(r["faults"])


def test_contacts(spark, tmp_path):
    site = {"value": "https://maker.example", "source_url": "https://maker.example/about", "source_authority": "FIRST_PARTY", "checked_at": "2025-02-01T10:00:00+00:00"}
    mail = site | {"value": "info@maker.example", "source_url": "https://maker.example/mail", "checked_at": "2025-02-20T10:00:00+00:00"}
    one = lambda n, currency="CURRENT", **fields: {"supplier_inn": tax_number(n), "company_name": f"Maker {n}", "content_currency": currency, "fields": fields}
    contacts = [
        one(1, website=site, email=mail), one(2, "OUTDATED", email=mail), one(3, "UNDATED", email=mail), one(4), one(5, email=mail | {"checked_at": "2024-01-01T00:00:00Z"}),
        one(6, email=mail | {"value": "no address"}), one(7, address=site | {"value": "Street 1"}), one(8, "OLD"), one(9, phone=mail | {"source_authority": "HEARSAY"}), one(10, website=site | {"checked_at": "2025-02-01"}), one(11), one(11),
    ]
    (tmp_path / "a.json").write_text(json.dumps({"contacts": contacts}), encoding="utf-8")
    got = {r["company_name"]: (r["freshness"], r["faults"], r["primary_source"]) for r in evidence.contact_records(evidence.read_contacts(spark, str(tmp_path)), dt.date(2025, 3, 1)).collect()}
    assert got["Maker 1"] == ("FRESH", [], "https://maker.example/mail")
    assert [got[f"Maker {n}"][0] for n in (2, 3, 4, 5)] == ["STALE", "UNKNOWN", "UNKNOWN", "STALE"]
    assert [got[f"Maker {n}"][1] for n in range(6, 12)] == [["email: value"], ["address: value"], ["content_currency"], ["phone: source_authority"], ["website: checked_at"], ["repeated supplier_inn"]]
