"""Enrichment and scalar queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import enrich, evidence, golden, ingest, positions, validation, websites
from ..session import table
from ..streaming import breaker, windows
from .registry import query

TODAY = date(2024, 2, 1)


@query(
    r"""WITH e AS (SELECT doc_id, 'EMAIL' AS kind, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))) AS value FROM documents),
 p AS (SELECT doc_id, 'PHONE' AS kind, regexp_replace(unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')), '[^0-9]', '', 'g') AS value FROM documents)
 SELECT DISTINCT doc_id, kind, value, CASE WHEN kind = 'EMAIL' THEN array_to_string(list_slice(string_split(lower(split_part(value, '@', 2)), '.'), -2, -1), '.') END AS domain FROM (SELECT * FROM e UNION ALL SELECT * FROM p)"""
)
def contact_extraction(spark, sf_dir):
    """Distinct e-mail addresses and telephone numbers of whole texts."""
    return enrich.contacts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    r"""WITH h AS (SELECT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages),
 d AS (SELECT url, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM h WHERE host <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY length(url), url) AS place, count(*) OVER (PARTITION BY domain) AS pages FROM d)
 SELECT domain, url, pages FROM r WHERE place = 1 ORDER BY pages DESC, domain LIMIT 4"""
)
def site_discovery(spark, sf_dir):
    """The best address of the domains with most pages."""
    return enrich.best_sites(table(spark, sf_dir, "pages"), 4)


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a),
 c AS (SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM b) SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM c"""
)
def page_text(spark, sf_dir):
    """Plain text of every page, as length and digest."""
    t = enrich.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM n WHERE event_type = 'error'),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS nth FROM b) SELECT user_id, CAST(island AS INTEGER) AS island, count(*) AS failures, min(ts) AS since, max(CASE WHEN nth = 2 THEN ts END) AS opened_at FROM k GROUP BY 1, 2"""
)
def breaker_islands(spark, sf_dir):
    """Runs of consecutive errors, and where each opens a circuit breaker."""
    return enrich.error_islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


_BREAKER = """WITH RECURSIVE n AS (SELECT event_id, user_id, ts, coalesce(event_type = 'error', false) AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, 0 AS failures, CAST(NULL AS TIMESTAMP) AS opened, '' AS outcome, false AS opens FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, n, event_id, ts, CASE WHEN skips THEN failures ELSE now END, CASE WHEN skips THEN opened WHEN now >= 2 THEN ts END, CASE WHEN skips THEN 'SKIPPED' WHEN failed THEN 'FAILED' ELSE 'ANSWERED' END, NOT skips AND now >= 2
  FROM (SELECT n.*, failures, opened, opened IS NOT NULL AND n.ts < opened + INTERVAL 900 SECOND AS skips, CASE WHEN failed THEN 1 + CASE WHEN opened IS NULL THEN failures ELSE 0 END ELSE 0 END AS now FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1))
 SELECT event_id, user_id, ts, outcome, opens FROM r WHERE n > 0"""


@query(_BREAKER)
def breaker_calls(spark, sf_dir):
    """What a breaker with a cool-down makes of every call."""
    return breaker.calls(table(spark, sf_dir, "events"))


@query(_BREAKER)
def breaker_stream(spark, sf_dir):
    """The same from a stream with state."""
    return breaker.stream_calls(spark, f"{sf_dir}/events.parquet")


@query(
    """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT c_custkey AS user_id, CASE WHEN last IS NULL THEN 'UNKNOWN' WHEN date_diff('day', CAST(last AS DATE), DATE '2024-02-01') <= 7 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM customer LEFT JOIN l ON l.user_id = c_custkey"""
)
def profile_freshness(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(last, "user_id", "left").select("user_id", enrich.freshness(F.col("last"), TODAY, 7).alias("freshness"))


_STATE = """h AS (SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type = 'purchase') AS found, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1),
 s AS (SELECT *, CASE WHEN found > 0 AND errors = 0 THEN 'COMPLETE' WHEN found > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM h), t AS (SELECT *, status <> 'COMPLETE' AND errors > 0 AS retryable FROM s)"""


@query("WITH " + _STATE + " SELECT * FROM t")
def enrichment_state(spark, sf_dir):
    return enrich.run_state(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("WITH " + _STATE + " SELECT status, retryable, count(*) AS profiles, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(errors) AS BIGINT) AS errors FROM t GROUP BY 1, 2")
def enrichment_coverage(spark, sf_dir):
    return enrichment_state(spark, sf_dir).groupBy("status", "retryable").agg(F.count("*").alias("profiles"), F.sum("runs").alias("runs"), F.sum("errors").alias("errors"))


@query(
    "WITH " + _STATE + """, a AS (SELECT user_id, date_diff('hour', max(ts), TIMESTAMP '2024-02-01') AS age FROM events GROUP BY 1) SELECT user_id, CASE WHEN status = 'PARTIAL' AND retryable THEN age < 24 WHEN status IN ('COMPLETE', 'PARTIAL') THEN age <= 720 WHEN status = 'FAILED' THEN NOT retryable OR age < 24 ELSE FALSE END AS reusable FROM t JOIN a USING (user_id)"""
)
def cache_reuse(spark, sf_dir):
    """Which stored profiles are returned without a new run."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    hours = F.floor(F.unix_timestamp(now.cast("timestamp")) / 3600) - F.floor(F.unix_timestamp(F.max("ts").cast("timestamp")) / 3600)
    age = table(spark, sf_dir, "events").groupBy("user_id").agg(hours.alias("age"))
    return enrichment_state(spark, sf_dir).join(age, "user_id").select("user_id", enrich.reusable(F.col("status"), F.col("retryable"), F.col("age")).alias("reusable"))


@query(
    """WITH o AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN event_id END) AS site, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS phone FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
 n AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN event_id END) AS site, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS phone FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
 j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, n.user_id IS NOT NULL AS ran, o.site AS os, n.site AS ns, o.phone AS op, n.phone AS np FROM o FULL JOIN n ON o.user_id = n.user_id)
 SELECT user_id, coalesce(ns, os) AS site, coalesce(np, op) AS phone, CASE WHEN NOT ran THEN 'UNTOUCHED' WHEN (ns IS NULL AND os IS NOT NULL) OR (np IS NULL AND op IS NOT NULL) THEN 'KEPT' ELSE 'REPLACED' END AS refresh,
 concat_ws('|', CASE WHEN ran AND ns IS NULL AND os IS NOT NULL THEN 'site' END, CASE WHEN ran AND np IS NULL AND op IS NOT NULL THEN 'phone' END) AS kept_fields FROM j"""
)
def weak_refresh(spark, sf_dir):
    """A later, weaker run merged with an earlier one."""
    e = table(spark, sf_dir, "events")
    fields = [F.max(F.when(F.col("event_type") == k, F.col("event_id"))).alias(n) for n, k in (("site", "view"), ("phone", "purchase"))]
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return enrich.merge_refresh(e.filter(F.col("ts") < cut).groupBy("user_id").agg(*fields), e.filter(F.col("ts") >= cut).groupBy("user_id").agg(*fields), "user_id", ["site", "phone"])


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 33 THEN 'MANUFACTURER' WHEN p_size = 46 THEN 'DISTRIBUTOR' END AS role FROM part")
def inferred_roles(spark, sf_dir):
    code = F.format_string("%02d.%d", "p_size", (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", enrich.role(code).alias("role"))


@query(
    """WITH r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS po, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 25 END AS mo, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS pn, c_mktsegment AS mn FROM customer),
 c AS (SELECT *, coalesce(po <> mo, FALSE) AS conflict FROM r) SELECT key, coalesce(po, CASE WHEN NOT conflict THEN mo END) AS ogrn, coalesce(pn, CASE WHEN NOT conflict THEN mn END) AS name, conflict FROM c"""
)
def merged_identities(spark, sf_dir):
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        c.alias("key"), F.when(c % 3 > 0, F.col("c_nationkey").cast("long")).alias("primary_ogrn"), F.when(c % 4 > 0, c % 25).alias("mirror_ogrn"), F.when(c % 5 > 0, F.col("c_name")).alias("primary_name"), F.col("c_mktsegment").alias("mirror_name")
    )
    return enrich.merge_identity(rows)


@query(
    """WITH n AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 5000000001) % 10000000000 AS VARCHAR), CASE WHEN c_custkey % 11 = 0 THEN 9 ELSE 10 END, '0') AS inn FROM customer),
 d AS (SELECT *, CASE WHEN length(inn) = 10 THEN (2 * CAST(inn[1] AS INT) + 4 * CAST(inn[2] AS INT) + 10 * CAST(inn[3] AS INT) + 3 * CAST(inn[4] AS INT) + 5 * CAST(inn[5] AS INT) + 9 * CAST(inn[6] AS INT) + 4 * CAST(inn[7] AS INT) + 6 * CAST(inn[8] AS INT) + 8 * CAST(inn[9] AS INT)) % 11 % 10 = CAST(inn[10] AS INT) END AS ok FROM n)
 SELECT c_custkey, inn, CASE WHEN length(inn) = 10 THEN 'legal_entity' ELSE 'unknown' END AS entity_type, CASE WHEN length(inn) = 10 THEN substr(inn, 1, 2) END AS region, CASE WHEN length(inn) <> 10 THEN 'INVALID_INN_FORMAT' WHEN NOT ok THEN 'INVALID_INN_CHECKSUM' END AS flag FROM d"""
)
def tax_numbers(spark, sf_dir):
    """Tax numbers made from keys, normalised and checked."""
    c = F.col("c_custkey")
    raw = F.lpad(((c * 7919 + 5000000001) % 10000000000).cast("string"), F.when(c % 11 == 0, 9).otherwise(10), "0")
    raw = F.concat(F.lit(" "), raw, F.lit("\t"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.inn(raw).alias("n")).select("c_custkey", "n.*")


@query(
    r"""WITH r AS (SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.12' WHEN 3 THEN '.12.3' WHEN 4 THEN '.12.30.' || CAST(p_partkey % 1000 AS VARCHAR) ELSE '.1x' END AS raw FROM part),
 s AS (SELECT *, CASE WHEN CAST(substr(raw, 1, 2) AS INT) IN (4, 34, 40, 44, 48, 54, 57, 67, 76, 83, 89, 0) THEN FALSE ELSE regexp_full_match(raw, '[0-9]{2}(\.([0-9]|[0-9]{2}(\.([0-9]|[0-9]{2}(\.[0-9]{1,3})?))?))?') END AS good, string_split(raw, '.') AS seg FROM r)
 SELECT p_partkey, CASE WHEN good THEN raw END AS code, CASE WHEN good THEN CAST(len(seg) AS INTEGER) END AS depth, CASE WHEN good AND len(seg) >= 2 THEN seg[1] || '.' || substr(seg[2], 1, 1) END AS subclass, CASE WHEN good AND len(seg) >= 2 AND length(seg[2]) = 2 THEN seg[1] || '.' || seg[2] END AS "group",
 CASE WHEN good AND len(seg) >= 3 THEN seg[1] || '.' || seg[2] || '.' || substr(seg[3], 1, 1) END AS subgroup, CASE WHEN good AND len(seg) >= 3 AND length(seg[3]) = 2 THEN seg[1] || '.' || seg[2] || '.' || seg[3] END AS kind, CASE WHEN NOT good THEN 'INVALID_OKPD2' END AS flag FROM s"""
)
def category_codes(spark, sf_dir):
    """Category codes of mixed depth made from parts, normalised."""
    p = F.col("p_partkey")
    tail = F.when(p % 6 == 0, "").when(p % 6 == 1, ".1").when(p % 6 == 2, ".12").when(p % 6 == 3, ".12.3").when(p % 6 == 4, F.concat(F.lit(".12.30."), (p % 1000).cast("string"))).otherwise(".1x")
    raw = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), tail)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.okpd2(raw).alias("o")).select("p_partkey", "o.code", "o.depth", "o.subclass", "o.group", "o.subgroup", "o.kind", "o.flag")


@query("SELECT l_orderkey, l_linenumber, sha256(CAST(l_orderkey AS VARCHAR) || chr(31) || CAST(l_partkey AS VARCHAR) || chr(31) || l_returnflag) AS digest FROM lineitem")
def item_digests(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.content_hash(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag")).alias("digest"))


#: The name space of ids; any UUID will do.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@query(
    """WITH h AS (SELECT s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST('supplier:' || s_suppkey AS BLOB)) AS h FROM supplier)
 SELECT s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST('0x' || substr(h, 17, 1) AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h"""
)
def stable_ids(spark, sf_dir):
    """Version-5 UUIDs as a SQL expression."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.uuid5(NAMESPACE, F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string"))).alias("uuid"))


@query(
    """SELECT 'positive price' AS rule, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, FALSE)) AS violations FROM orders UNION ALL SELECT 'known status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), FALSE)) FROM orders
 UNION ALL SELECT 'priority shape', count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')) FROM orders UNION ALL SELECT 'date in range', count(*) FILTER (WHERE NOT coalesce(o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-01-01', FALSE)) FROM orders"""
)
def contract_violations(spark, sf_dir):
    rules = {
        "positive price": "o_totalprice > 0",
        "known status": "o_orderstatus in ('F', 'O')",
        "priority shape": "o_orderpriority rlike '^[1-5]-[A-Z ]+$'",
        "date in range": "o_orderdate between timestamp_ntz'1995-01-01 00:00:00' and timestamp_ntz'2001-01-01 00:00:00'",
    }
    return enrich.violations(table(spark, sf_dir, "orders"), rules)


def _twin(name: str, steps: list[str]) -> str:
    """A chain of views, each an expression of the one before as ``t``."""
    return ", ".join(f"{name}{i + 1} AS (SELECT doc_id, {e} AS t FROM {name}{i})" for i, e in enumerate(steps))


def _quoted(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


_W, _D = r"[\p{L}\p{N}]", r"\p{Nd}"
#: Without looking around, marks that stay are first moved to private characters.
_KEPT = {".": "\ue001", ",": "\ue002", "%": "\ue003", "-": "\ue004", "/": "\ue005", "+": "\ue006"}


def _keep(pattern: str, mark: str) -> str:
    """Twice, as neighbouring matches overlap."""
    return f"regexp_replace(regexp_replace(t, '{pattern}', '\\1{_KEPT[mark]}\\2', 'g'), '{pattern}', '\\1{_KEPT[mark]}\\2', 'g')"


_STEPS = [
    f"lower(translate(nfc_normalize(text), {_quoted(text.SOURCE)}, {_quoted(text.TARGET)}))",
    "replace(replace(replace(replace(t, 'м²', 'м2'), 'м³', 'м3'), 'm²', 'm2'), 'm³', 'm3')",
    r"""regexp_replace(t, '[²³¹\x{2070}-\x{209f}]|[^\p{L}\p{N}\s.,/+"%*-]', ' ', 'g')""",
    _keep(rf"({_D})\.({_D})", "."),
    _keep(rf"({_D}),({_D})", ","),
    "translate(replace(replace(t, '.', ' '), ',', ' '), '\ue001\ue002', '.,')",
    """CASE WHEN contains(t, '"') THEN list_reduce(list_prepend({'out': string_split(t, '"')[1], 'p': string_split(t, '"')[1], 'i': 0, 'n': 0, 'q': FALSE}, list_transform(string_split(t, '"')[2:], lambda p, i: {'out': '', 'p': p, 'i': i, 'n': len(string_split(t, '"')) - 1, 'q': FALSE})),
 lambda s, x: {'out': s.out || CASE WHEN NOT s.q AND regexp_matches(s.p, '\\p{Nd}$') THEN '"' ELSE ' ' END || x.p, 'p': x.p, 'i': x.i, 'n': x.n,
 'q': NOT s.q AND NOT regexp_matches(s.p, '\\p{Nd}$') AND CASE WHEN x.p = '' THEN x.i < x.n ELSE NOT regexp_matches(x.p, '^[\\s\\p{Z}\\x{85}]') END}).out ELSE t END""",
    _keep(rf"({_D})%()", "%"),
    "translate(replace(t, '%', ' '), '\ue003', '%')",
    *[_keep(rf"({_W})[{m}]({_W})", m) for m in "-/+"],
    "translate(regexp_replace(t, '[/+-]', ' ', 'g'), '\ue004\ue005\ue006', '-/+')",
    r"regexp_replace(t, '[\s\p{Z}\x{85}]+', ' ', 'g')",
    *[rf"regexp_replace(t, '({_D}){s}[xх*]{s}({_D})', '\1x\2', 'g')" for s in ("", " ", "", " ")],
    "trim(regexp_replace(t, '[* ]+', ' ', 'g'))",
]


@query(
    f"WITH n0 AS (SELECT doc_id, text FROM documents), {_twin('n', _STEPS)}, f AS (SELECT doc_id, nullif(t, '') AS t FROM n{len(_STEPS)}), "
    + r"""x AS (SELECT doc_id, t, string_split(coalesce(t, ''), ' ') AS w FROM f)
 SELECT doc_id, md5(t) AS digest, CAST(len(list_distinct(list_filter(list_transform(w, lambda x: regexp_replace(x, '^["%]+|["%]+$', '', 'g')), lambda x: length(x) >= 5 AND regexp_matches(x, '\p{L}') AND regexp_matches(x, '[0-9]')))) AS INTEGER) AS technical,
 CAST(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) AS INTEGER) AS numeric FROM x"""
)
def normalized_texts(spark, sf_dir):
    """Search form of every whole text, as digest and markers."""
    docs = text.normalize(table(spark, sf_dir, "documents"), "text", "t").select("doc_id", "t")
    return docs.select("doc_id", F.md5("t").alias("digest"), F.size(scalars.tech_tokens(F.col("t"))).alias("technical"), F.size(scalars.numeric_tokens(F.col("t"))).alias("numeric"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1, 2")
def event_days(spark, sf_dir):
    """Daily counts by a stream with a watermark, run to its end."""
    return windows.daily_counts(spark, f"{sf_dir}/events.parquet")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_props(spark, sf_dir):
    """JSON properties of the log, counted."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "SELECT c_custkey, flags FROM (SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 2 = 0 THEN 'INVALID_INN_FORMAT' END, CASE WHEN c_custkey % 5 = 0 THEN 'MISSING_KPP' END, CASE WHEN c_custkey % 3 = 0 THEN 'MISSING_SUBJECT' END) AS flags FROM customer) x"
)
def ordered_flags(spark, sf_dir):
    """Flags in the contract's order, whatever order they came in."""
    c = F.col("c_custkey")
    flags = F.array_compact(F.array(F.when(c % 3 == 0, "MISSING_SUBJECT"), F.when(c % 5 == 0, "MISSING_KPP"), F.when(c % 2 == 0, "INVALID_INN_FORMAT"), F.when(c % 3 == 0, "MISSING_SUBJECT")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", ingest.sort_flags(flags)).alias("flags"))


_PLACE = r"(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})"


@query(
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_PLACE}') AS raws, regexp_split_to_array(text, '{_PLACE}') AS gaps FROM documents WHERE text IS NOT NULL),
 o AS (SELECT doc_id, raws, gaps, unnest(range(1, len(raws) + 1)) AS i FROM d),
 p AS (SELECT doc_id, raws[i] AS raw, array_to_string(list_transform(range(1, i), lambda j: gaps[j] || raws[j]), '') || gaps[i] AS head, array_to_string(list_transform(range(i + 1, len(raws) + 1), lambda j: gaps[j] || raws[j]), '') || gaps[len(raws) + 1] AS rest FROM o)
 SELECT doc_id, CAST(length(head) AS INT) AS at, raw, right(head, 90) AS before, left(rest, 40) AS after FROM p"""
)
def contact_places(spark, sf_dir):
    """Every place of an address or number in whole texts, with the text around it."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(positions.occurrences(F.col("text"), _PLACE)).alias("f")).select("doc_id", "f.*")


_NINE = " + ".join(f"{w} * CAST(substr(nine, {i + 1}, 1) AS INTEGER)" for i, w in enumerate(scalars.W10))


@query(
    f"""WITH r AS (SELECT l_suppkey AS s, l_returnflag AS f, l_linestatus AS o, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY 1, 2, 3), c0 AS (SELECT s_suppkey AS s, s_name AS name, '77' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS nine FROM supplier),
 c AS (SELECT *, nine || CAST((({_NINE}) % 11 % 10 + CASE WHEN s % 17 = 16 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS inn, CASE s % 4 WHEN 0 THEN 'UNDER_REVIEW' WHEN 1 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS status FROM c0),
 e AS (SELECT s, f, CASE WHEN (s + n) % 5 = 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS state, CASE n % 4 WHEN 3 THEN 'WEAK' WHEN 1 THEN 'MODERATE' ELSE 'STRONG' END AS strength, n % 3 <> 0 AS direct, n % 7 <> 0 AND n % 11 <> 0 AS open, n % 29 = 0 AS unnamed, n % 6 = 0 AS exact, n % 31 = 0 AS ran_out FROM r),
 x AS (SELECT s, count(*) AS evidence_count, count(*) FILTER (state = 'ACTIVE') AS active_evidence_count, coalesce(bool_or(exact), false) AS exact, count(*) FILTER (f = 'R' AND unnamed) + count(*) FILTER (ran_out AND state = 'ACTIVE') AS bad_records,
  coalesce(bool_or(f = 'R' AND state = 'ACTIVE' AND strength = 'STRONG' AND direct AND open), false) AS declared, coalesce(bool_or(f = 'A' AND state = 'ACTIVE' AND strength = 'STRONG' AND open), false) AND coalesce(bool_or(f = 'N' AND state = 'ACTIVE' AND strength <> 'WEAK' AND direct AND open), false) AS joint FROM e GROUP BY 1),
 y AS (SELECT c.s, inn, name, status, evidence_count, active_evidence_count, declared AND s % 13 <> 4 AS declared, joint AND s % 13 <> 4 AS joint, CASE WHEN s % 17 = 16 THEN 2 ELSE 0 END + CASE WHEN s % 19 = 5 THEN 1 ELSE 0 END + CASE WHEN status = 'UNDER_REVIEW' AND s % 8 = 0 THEN 1 ELSE 0 END
  + CASE WHEN status = 'VERIFIED' AND s % 23 = 2 THEN 1 ELSE 0 END + CASE WHEN status = 'VERIFIED' AND s % 9 = 7 THEN 1 ELSE 0 END + CASE WHEN status = 'VERIFIED' AND NOT ((declared OR joint) AND s % 13 <> 4) THEN 1 ELSE 0 END + bad_records AS faults FROM c JOIN x USING (s))
 SELECT inn AS supplier_inn, name AS company_name, CASE WHEN faults = 0 THEN status END AS verification_status, CASE WHEN faults > 0 THEN NULL WHEN status = 'UNDER_REVIEW' THEN 'REVIEW' WHEN status = 'UNVERIFIED' THEN 'NONE' WHEN declared THEN 'DECLARATION' ELSE 'IDENTITY_AND_LISTING' END AS basis,
 CAST(evidence_count AS INTEGER) AS evidence_count, CAST(active_evidence_count AS INTEGER) AS active_evidence_count, CAST(faults AS INTEGER) AS faults FROM y"""
)
def evidence_policy(spark, sf_dir):
    """Conclusions about suppliers as curated candidates: each kind of line of a
    supplier is one evidence record, and its counts decide the record's fields."""
    pick = lambda c, *words: F.element_at(F.array(*map(F.lit, words)), (c + 1).cast("int"))
    n, s = F.col("n"), F.col("s")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("o")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("d"))
    kind = {"evidence_type": ("CONFORMITY_DECLARATION", "LEGAL_IDENTITY", "CURRENT_PRODUCT_LISTING"), "role_assertion": ("MANUFACTURER_AND_APPLICANT", "ACTIVE_LEGAL_ENTITY", "MANUFACTURER_NAMED_ON_PRODUCT_LISTING")}
    of = {k: F.when(F.col("f") == "R", v[0]).when(F.col("f") == "A", v[1]).otherwise(v[2]) for k, v in kind.items()}
    of |= {
        "evidence_status": F.when((s + n) % 5 == 0, "SUSPENDED").otherwise("ACTIVE"), "verification_strength": pick(n % 4, "STRONG", "MODERATE", "STRONG", "WEAK"), "target_product_support": F.when(n % 3 == 0, "RELATED").otherwise("DIRECT"),
        "source_name": F.lit("lines"), "source_authority": F.lit("FIRST_PARTY"), "source_url": F.when(n % 7 != 0, F.when(n % 11 == 0, "ftp://lines.example").otherwise("https://lines.example/1")), "source_record_id": F.when(n % 29 != 0, n.cast("string")),
        "asserted_okpd2_codes": F.when(n % 6 == 0, F.array(F.lit("10.51.11"))), "evidence_date": F.date_format("d", "yyyy-MM-dd"), "valid_until": F.when(n % 31 == 0, "2009-12-31"), "retrieved_at": F.lit("2009-06-01T00:00:00Z"),
    }
    names = "evidence_type source_name source_url source_record_id source_authority evidence_status verification_strength role_assertion target_product_support product_scope asserted_okpd2_codes evidence_date valid_until retrieved_at notes"
    record = F.struct(*[of.get(k, F.lit(None)).alias(k) for k in names.split()]).cast(evidence.RECORD)
    records = lines.groupBy("s").agg(F.collect_list(record).alias("evidence_records"))
    nine = F.concat(F.lit("77"), F.lpad(s.cast("string"), 7, "0"))
    control = sum((F.lit(w) * F.substring(nine, i + 1, 1).cast("int") for i, w in enumerate(scalars.W10)), F.lit(0)) % 11 % 10
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_name").alias("canonical_name")).join(records, "s").select(
        F.lit("10.51.11").alias("target_okpd2"), F.lit("2010-01-01T00:00:00Z").alias("checked_at"), F.concat(nine, ((control + F.when(s % 17 == 16, 1).otherwise(0)) % 10).cast("string")).alias("supplier_inn"), "canonical_name",
        F.array().cast("array<string>").alias("aliases"), F.lit("UNKNOWN").alias("market_role"), pick(s % 4, "UNDER_REVIEW", "UNVERIFIED", "VERIFIED", "VERIFIED").alias("verification_status"), F.when(s % 9 == 7, "WEAK").otherwise("STRONG").alias("overall_strength"),
        F.when(s % 13 == 4, "HISTORICAL_DIRECT_PRODUCT_TEXT").otherwise("DIRECT_PRODUCT_TEXT").alias("target_product_match"),
        (F.coalesce(F.exists("evidence_records", lambda e: F.size(e["asserted_okpd2_codes"]) > 0), F.lit(False)) != (s % 19 == 5)).alias("exact_okpd2_asserted_by_source"),
        F.array().cast("array<string>").alias("verification_reason_codes"), F.when((s % 4 == 0) & (s % 8 != 0) | (s % 4 >= 2) & (s % 23 == 2), F.array(F.lit("ROLE_UNCLEAR"))).alias("review_reasons"), "evidence_records", (s % 17 == 16).alias("_unknown"),
    )
    known = rows.filter("not _unknown").select("supplier_inn", "target_okpd2", F.lit("EXTERNAL_NEW").alias("reconciliation_status"))
    return evidence.judged(rows, known).select("supplier_inn", "company_name", "verification_status", "basis", "evidence_count", "active_evidence_count", F.size("faults").alias("faults"))


@query(
    """WITH p AS (SELECT doc_id // 3 AS site, doc_id // 3 % (SELECT count(*) FROM supplier) AS supplier_id, CASE WHEN text IS NOT NULL THEN (doc_id * 7 + doc_id // 8) % 8 ELSE 6 END AS c FROM documents),
 s AS (SELECT site, supplier_id, bool_or(c = 0) AS inn, bool_or(c = 7) AS ogrn, bool_or(c = 1) AND NOT bool_or(c IN (0, 7)) AS warned, bool_or(c = 3) AS kpp, bool_or(c IN (2, 3, 4)) AS name, bool_or(c IN (2, 4)) AS place, bool_or(c = 2) AS street, bool_or(c = 5) AS list FROM p GROUP BY 1, 2),
 g AS (SELECT *, CASE WHEN list OR warned THEN 'LOW' WHEN inn OR ogrn OR name AND (street OR kpp) THEN 'HIGH' WHEN name AND place THEN 'MEDIUM' ELSE 'LOW' END AS grade FROM s JOIN supplier ON s_suppkey = supplier_id)
 SELECT site, supplier_id, concat_ws(' ', CASE WHEN inn THEN 'INN_ON_SITE' END, CASE WHEN ogrn THEN 'OGRN_ON_SITE' END, CASE WHEN warned THEN 'ID_ONLY_IN_WARNING_CONTEXT' END, CASE WHEN kpp THEN 'KPP_ON_SITE' END, CASE WHEN name THEN 'EXACT_LEGAL_NAME' END, CASE WHEN place THEN 'REGISTERED_LOCALITY' END,
 CASE WHEN street THEN 'REGISTERED_STREET_ADDRESS' END, CASE WHEN list THEN 'DIRECTORY_LIKE' END) AS signals, grade, CASE WHEN grade <> 'HIGH' THEN 'REJECTED' WHEN inn OR ogrn THEN 'VERIFIED_STRONG' ELSE 'VERIFIED_COMPOSITE' END AS status FROM g"""
)
def website_grades(spark, sf_dir):
    """Identity of sites: three documents in a row are a site's pages, each
    headed by one of eight ways to name, or not to name, the supplier it is a candidate for."""
    s = F.col("supplier_id")
    nine = F.concat(F.lit("77"), F.lpad(s.cast("string"), 7, "0"))
    control = sum((F.lit(w) * F.substring(nine, i + 1, 1).cast("int") for i, w in enumerate(scalars.W10)), F.lit(0)) % 11 % 10
    house = (s % 90 + 10).cast("string")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"))
    known = suppliers.select(
        "*", F.concat(nine, control.cast("string")).alias("inn"), F.concat(F.lit("1"), F.lpad(s.cast("string"), 12, "0")).alias("ogrn"), F.concat(F.lpad((s % 10000).cast("string"), 4, "0"), F.lit("01001")).alias("kpp"),
        F.concat(F.lit('ООО "'), "name", F.lit('"')).alias("legal_name"), F.lit(None).cast("string").alias("short_name"), F.concat(F.lit("170000, г. Тверь, ул. Лесная, д. "), house).alias("address"),
    )
    n = suppliers.count()
    pages = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("site"), ((F.col("doc_id") * 7 + F.floor(F.col("doc_id") / 8)) % 8).alias("c"), F.col("text").alias("body")).withColumn("supplier_id", F.col("site") % n)
    heads = [
        F.concat(F.lit("ИНН "), "inn"), F.concat(F.lit("Осторожно, мошенники: ИНН "), "inn", F.lit(", ОГРН "), "ogrn"), F.concat("name", F.lit(", Тверь, Лесная, "), house), F.concat("name", F.lit(" КПП "), "kpp"),
        F.concat("name", F.lit(", Тверь")), F.lit("ИНН 1111111111, ИНН 2222222222, ИНН 3333333333"), F.lit(""), F.concat(F.lit("x"), "name", F.lit(", ОГРН "), "ogrn"),
    ]
    head = F.coalesce(*[F.when(F.col("c") == i, h) for i, h in enumerate(heads)])
    told = pages.join(known, "supplier_id").select("site", "supplier_id", F.concat(head, F.lit(". "), "body").alias("text"), F.lit(None).cast("string").alias("html"))
    return websites.graded(told, known).withColumn("signals", F.array_join("signals", " "))


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM supplier), d AS (SELECT doc_id, doc_id % n AS s, unnest(regexp_extract_all(text, '{_PLACE}')) AS raw FROM documents, n),
 v AS (SELECT doc_id, s, CASE WHEN contains(raw, '@') THEN 'EMAIL' ELSE 'PHONE' END AS kind, CASE WHEN contains(raw, '@') THEN lower(raw) ELSE regexp_replace(raw, '[^0-9]', '', 'g') END AS value FROM d),
 k AS (SELECT s, kind, value, bool_or(doc_id % 3 = 0) AS good, bool_or(doc_id % 3 = 1) AS bad FROM v GROUP BY 1, 2, 3), g AS (SELECT s, kind, bool_or(good) AS eligible, count(*) FILTER (good) > 0 AS hit FROM k GROUP BY 1, 2),
 t AS (SELECT kind, count(*) AS returned, count(*) FILTER (good) AS correct, count(*) FILTER (bad) AS wrong, count(*) FILTER (NOT good AND NOT bad) AS unlisted FROM v JOIN k USING (s, kind, value) GROUP BY 1),
 p AS (SELECT kind, count(*) FILTER (eligible) AS eligible, count(*) AS found, count(*) FILTER (eligible AND hit) AS covered FROM g GROUP BY 1),
 w AS (SELECT s_suppkey AS s, site FROM supplier LEFT JOIN (SELECT page_id % n AS s, min(url) AS site FROM pages, n WHERE contains(url, '://') GROUP BY 1) ON s = s_suppkey),
 o AS (SELECT 'WEBSITE' AS kind, count(*) FILTER (s % 4 <> 0) AS eligible, count(site) AS found, count(*) FILTER (s % 4 = 1 AND site IS NOT NULL) AS covered, count(site) AS returned, count(*) FILTER (s % 4 = 1 AND site IS NOT NULL) AS correct,
  count(*) FILTER (s % 4 IN (0, 2) AND site IS NOT NULL) AS wrong, count(*) FILTER (s % 4 = 3 AND site IS NOT NULL) AS unlisted FROM w),
 a AS (SELECT * FROM o UNION ALL SELECT x.kind, coalesce(eligible, 0), coalesce(found, 0), coalesce(covered, 0), coalesce(returned, 0), coalesce(correct, 0), coalesce(wrong, 0), coalesce(unlisted, 0) FROM (VALUES ('PHONE'), ('EMAIL')) x(kind) LEFT JOIN p USING (kind) LEFT JOIN t USING (kind))
 SELECT *, CASE WHEN eligible > 0 THEN round(100 * covered / eligible, 1) END AS coverage, CASE WHEN returned > 0 THEN round(100 * correct / returned, 1) END AS "precision" FROM a"""
)
def contact_golden(spark, sf_dir):
    """Scores of contacts in the documents (of a supplier by their number) and of
    suppliers' first pages as websites; document numbers decide what was expected."""
    n = table(spark, sf_dir, "supplier").count()
    kind = F.when(F.contains(F.col("raw"), F.lit("@")), "EMAIL").otherwise("PHONE")
    places = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("supplier_id"), F.explode(F.regexp_extract_all("text", F.lit(_PLACE), F.lit(0))).alias("raw")).withColumn("kind", kind)
    told = places.filter("doc_id % 3 < 2").select("supplier_id", "kind", golden.value_of(F.col("kind"), F.col("raw")).alias("value"), (F.col("doc_id") % 3 == 0).alias("acceptable"))
    sites = table(spark, sf_dir, "pages").filter(F.contains(F.col("url"), F.lit("://"))).groupBy((F.col("page_id") % n).alias("supplier_id")).agg(F.min("url").alias("website"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"))
    own, other = F.array(scalars.registrable_domain(scalars.host(F.col("website")))), F.array(F.lit("other.example"))
    s = F.col("supplier_id") % 4
    expected = suppliers.join(sites, "supplier_id", "left").select("supplier_id", F.when(s == 1, own).when(s > 1, other).alias("domains"), F.when(s == 3, own).alias("same_domains"))
    return golden.scores(suppliers, golden.website_verdicts(expected, sites), told, golden.value_verdicts(told, places))


@query(
    """WITH p AS (SELECT p_partkey AS item, string_split(p_name, ' ') AS t, p_size AS s, (10 + p_size % 5) || '.' || (10 + p_size) AS c, (10 + (p_size + 1) % 5) || '.' || (11 + p_size) AS other FROM part), k AS (SELECT c, min(t[1]) AS token FROM p GROUP BY 1),
 o AS (SELECT c FROM p GROUP BY c HAVING min(s) % 5 <> 4), x AS (SELECT item, CASE WHEN item % 7 <> 0 THEN p.c END AS given, other, item % 3 = 0 AS resolved, token, item % 7 <> 0 AND o.c IS NOT NULL AS own, list_contains(t, token) AS met FROM p JOIN k USING (c) LEFT JOIN o ON o.c = p.c),
 y AS (SELECT *, CASE WHEN own AND met THEN 'SUPPLIED_ALIGNED' WHEN resolved THEN 'RESOLVED_FROM_TEXT' WHEN own THEN 'SUPPLIED_UNVERIFIED' ELSE 'UNRESOLVED' END AS status FROM x)
 SELECT item, CASE status WHEN 'RESOLVED_FROM_TEXT' THEN other WHEN 'UNRESOLVED' THEN NULL ELSE given END AS code, status, CASE WHEN status = 'SUPPLIED_ALIGNED' THEN token ELSE '' END AS shared FROM y"""
)
def code_validation(spark, sf_dir):
    """Codes that sizes stand for, held against the parts' names: every seventh
    is malformed, every third name resolves to the next size's code."""
    s, item = F.col("s"), F.col("item")
    code = lambda n: F.concat_ws(".", (10 + n % 5).cast("string"), (10 + n).cast("string"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split("p_name", " ").alias("tokens"), F.col("p_size").alias("s")).withColumn("own", code(s))
    known = parts.groupBy(F.col("own").alias("code")).agg(F.min(F.col("tokens")[0]).alias("token"))
    official = parts.groupBy(F.col("own").alias("code")).agg(F.min("s").alias("s")).filter("s % 5 <> 4").select("code", F.lit("size").alias("name"))
    resolved = parts.filter("item % 3 = 0").select("item", F.lit("RESOLVED").alias("state"), code(s + 1).alias("ranking_code"), F.array(code(s + 1)).alias("suggestions"))
    out = validation.validated(parts.select("item", F.when(item % 7 == 0, F.concat("own", F.lit("x"))).otherwise(F.col("own")).alias("code"), "tokens"), official, known, resolved)
    return out.withColumn("shared", F.array_join("shared", " "))
