"""Deliveries written from the tables and read back, and single normalisers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluation, sealed, search
from ..session import folder, table
from ..sources import canonical, files
from ..sources.canonical import History
from .registry import query


@query("SELECT CAST(l_orderkey AS VARCHAR) AS lot_id, p_name AS product_name, p_type || ';' || p_brand AS okpd2_code, count(*) AS n, TRUE AS numbered FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3")
def delivered_items(spark, sf_dir):
    """All items exported as a delimited delivery, with separators inside
    values, and scanned again: every row comes back, numbered in file order."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.select(F.col("l_orderkey").cast("string").alias("lot_id"), F.col("p_name").alias("product_name"), F.concat_ws(";", "p_type", "p_brand").alias("okpd2_code"))
    path = folder(spark)
    rows.write.options(sep=";", quote='"', escape='"', header=True).csv(path)
    back = files.delimited(spark, path, "items")
    return back.groupBy("lot_id", "product_name", "okpd2_code").agg(F.count("*").alias("n"), F.bool_and(F.col("row_no") >= 1).alias("numbered"))


@query("SELECT o_orderkey AS lot_id, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'")
def exported_lots(spark, sf_dir):
    """Lots written as JSON with fixed columns and read back."""
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("lot_id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), "o_custkey")
    path = folder(spark)
    files.export(rows, path, "json", ["lot_id", "priority", "price"])
    return spark.read.schema("lot_id long, priority string, price double").json(path)


@query("SELECT TRUE AS equal, 0 AS drift, count(*) > 0 AS pinned FROM region")
def pinned_source(spark, sf_dir):
    """A delivery's header meets its contract, and two reads of its files have the same checksums."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lot_id"), F.col("l_suppkey").alias("supplier_inn"), F.lit("").alias("supplier_kpp"), (F.col("l_returnflag") == "R").alias("is_winner"))
    path = folder(spark)
    rows.write.options(sep=";", header=True).csv(path)
    first, second = files.checksums(spark, f"{path}/*.csv"), files.checksums(spark, f"{path}/*.csv").withColumnRenamed("sha256", "again")
    drift = len(files.header_drift(spark, f"{path}/*.csv", "suppliers"))
    return first.join(second, ["path", "size_bytes"]).agg(F.bool_and(F.col("sha256") == F.col("again")).alias("equal"), F.lit(drift).alias("drift"), (F.count("*") > 0).alias("pinned"))


_UNSAFE = "o_orderkey % 97 = 0"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, l_linenumber, p_name AS name, p_type AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE NOT ({_UNSAFE})")
def contract_documents(spark, sf_dir):
    """Orders as contract documents in XML, parsed back to items; documents
    with a doctype are refused."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    product = F.struct("l_linenumber", F.col("p_name").alias("name"), F.col("p_type").alias("code"))
    # an order has a handful of lines
    docs = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(product)).alias("p"))
    text = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    one = lambda x: F.concat(F.lit("<product><name>"), text(x["name"]), F.lit("</name><OKPD2><code>"), text(x["code"]), F.lit("</code></OKPD2><price>"), x["l_linenumber"].cast("string"), F.lit("</price></product>"))
    xml = F.concat(F.when(F.expr(_UNSAFE), "<!DOCTYPE contract>").otherwise(""), F.lit("<contract><id>"), F.col("o_orderkey").cast("string"), F.lit("</id><products>"), F.array_join(F.transform("p", one), ""), F.lit("</products></contract>"))
    parsed = files.contracts(docs.select(xml.alias("xml")))
    items = parsed.select("id", F.explode("products").alias("p"))
    return items.select("id", F.col("p.price").cast("int").alias("l_linenumber"), F.col("p.name").alias("name"), F.col("p.OKPD2.code").alias("code"))


_KPP = "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 7701' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') || ' ' WHEN 2 THEN '7701AB' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') ELSE '77' || CAST(s_suppkey AS VARCHAR) || 'x' END"


@query(f"SELECT s_suppkey, nullif(trim({_KPP}), '') AS kpp, CASE s_suppkey % 4 WHEN 0 THEN 'MISSING_KPP' WHEN 3 THEN 'INVALID_KPP_FORMAT' END AS flag FROM supplier")
def registration_codes(spark, sf_dir):
    """Registration codes of all suppliers, in four shapes of writing."""
    raw = F.expr(_KPP.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.kpp(raw).alias("k")).select("s_suppkey", "k.kpp", "k.flag")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(round(o_totalprice, 2) AS DECIMAL(19, 4)) WHEN o_orderkey % 5 = 4 THEN CAST(0 AS DECIMAL(19, 4)) END AS value, CASE o_orderkey % 5 WHEN 4 THEN 'ZERO_START_PRICE' END AS flag, o_orderkey % 5 = 3 AS structural,
 CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS small, CASE o_orderkey % 3 WHEN 0 THEN 'AIS_GZ' WHEN 1 THEN 'EM' END AS platform FROM orders"""
)
def typed_fields(spark, sf_dir):
    """Prices, dates, flags and platforms as deliveries write them, well and badly."""
    k = F.col("o_orderkey")
    price = F.when(k % 5 < 3, F.round("o_totalprice", 2).cast("decimal(15,2)").cast("string")).when(k % 5 == 3, F.concat(F.lit("-"), k.cast("string"))).otherwise("0.00")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", " yyyy-MM-dd ")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    flag = F.element_at(F.array(F.lit("true"), F.lit(" false "), F.lit("True"), F.lit("0")), (k % 4 + 1).cast("int"))
    name = F.element_at(F.array(F.lit("АИС ГЗ"), F.lit(" ЭМ"), F.lit("АИС")), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k, scalars.price(price).alias("p"), scalars.iso_date(day).alias("day"), scalars.strict_bool(flag).alias("small"), scalars.platform(name).alias("platform"))
    return rows.select("o_orderkey", "p.value", "p.flag", "p.structural", "day", "small", "platform")


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN p_name || ' 2' END AS variant, CASE WHEN p_size % 2 = 0 THEN 'тип ' || CAST(p_size AS VARCHAR) END AS marker FROM part"""
)
def name_variants(spark, sf_dir):
    """Procedure names that say something else than the subject, and type markers of titles."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("«"), F.upper("p_name"), F.lit("»!"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_name"), F.lit(" 2"))).otherwise(" ")
    size = F.col("p_size").cast("string")
    title = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", F.lit("тип"), size)).otherwise(F.concat_ws(" ", "p_name", F.lit("подтип"), size))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.name_variant(name, F.col("p_name")).alias("variant"), scalars.type_marker(title).alias("marker"))


_CODE = "CASE p_partkey % 4 WHEN 0 THEN '10.5' || CAST(p_size % 3 AS VARCHAR) || '.1' || CAST(p_size % 2 AS VARCHAR) || '.14' || CAST(p_size % 5 AS VARCHAR) WHEN 1 THEN '10.5' || CAST(p_size % 3 AS VARCHAR) || '.1' WHEN 2 THEN '10.5' || CAST(p_size % 3 AS VARCHAR) || '.1' || CAST(p_size % 2 AS VARCHAR) ELSE '10' END"


@query(
    f"""WITH c AS (SELECT p_partkey, {_CODE} AS code FROM part), p AS (SELECT a.p_partkey, a.code AS a, b.code AS b, length(a.code) AS la, length(b.code) AS lb FROM c a JOIN c b ON b.p_partkey = a.p_partkey + 1),
 s AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN la <> 12 AND lb <> 12 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0.8 WHEN la = 12 AND lb <> 12 AND starts_with(a, b) THEN 0.8 WHEN lb = 12 AND la <> 12 AND starts_with(b, a) THEN 0.8
 WHEN la >= 8 AND lb >= 8 AND left(a, 8) = left(b, 8) THEN 0.7 WHEN la >= 7 AND lb >= 7 AND left(a, 7) = left(b, 7) THEN 0.55 WHEN la >= 5 AND lb >= 5 AND left(a, 5) = left(b, 5) THEN 0.4 WHEN la >= 4 AND lb >= 4 AND left(a, 4) = left(b, 4) THEN 0.25 WHEN left(a, 2) = left(b, 2) THEN 0.1 ELSE 0.0 END AS similarity,
 CASE WHEN a = b THEN 3 WHEN la >= 5 AND lb >= 5 AND left(a, 5) = left(b, 5) THEN 2 WHEN left(a, 2) = left(b, 2) THEN 1 ELSE 0 END AS relation FROM p)
 SELECT p_partkey, a, b, CAST(similarity AS DOUBLE) AS similarity, relation, CASE WHEN relation >= 2 THEN 'ALIGNED' WHEN relation = 1 THEN 'UNCERTAIN' ELSE 'MISMATCH' END AS alignment FROM s"""
)
def code_similarity(spark, sf_dir):
    """Similarity, relation and alignment of neighbouring parts' codes of mixed depth."""
    codes = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE.replace("VARCHAR", "STRING")).alias("code"))
    pairs = codes.withColumnRenamed("code", "a").join(codes.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("code").alias("b")), "p_partkey")
    relation = scalars.code_relation(F.col("a"), F.col("b"))
    out = pairs.withColumns({"qa": scalars.okpd2(F.col("a")), "qb": scalars.okpd2(F.col("b")), "relation": relation})
    return out.select("p_partkey", "a", "b", scalars.okpd2_similarity(F.col("qa"), F.col("qb")).alias("similarity"), "relation", scalars.alignment(F.col("relation")).alias("alignment"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT a.vec_id, list_dot_product(a.e, b.e) AS d FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(d, 6) AS cosine, round(least(1.0, greatest(0.0, (d - 0.82) / (0.95 - 0.82))), 5) AS calibrated FROM x"""
)
def calibrated_neighbours(spark, sf_dir):
    """Cosine of neighbouring unit vectors, and its calibrated value."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", scalars.dot(F.col("embedding"), F.col("other")).alias("d"))
    return pairs.select("vec_id", F.round("d", 6).alias("cosine"), F.round(scalars.calibrated(F.col("d")), 5).alias("calibrated"))


@query("""SELECT o_orderkey, to_base64(encode('{"lot":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}')) AS search_id FROM orders""")
def search_ids(spark, sf_dir):
    """Stateless ids of searches."""
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.search_id(F.col("o_orderkey").alias("lot"), F.col("o_orderpriority").alias("priority")).alias("search_id"))


@query(
    r"""WITH k AS (SELECT doc_id, text, '%' || replace(replace(replace(x, '\', '\\'), '%', '\%'), '_', '\_') || '%' AS pattern, x FROM documents, (SELECT unnest(['%', '_', '50%', 'a_b', '\', '.com']) AS x) WHERE text IS NOT NULL)
 SELECT x AS needle, count(*) FILTER (WHERE text LIKE pattern ESCAPE '\') AS documents FROM k GROUP BY 1"""
)
def literal_wildcards(spark, sf_dir):
    """In how many texts a needle with wildcards of LIKE occurs as plain characters."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    needles = F.array(*[F.lit(x) for x in ("%", "_", "50%", "a_b", "\\", ".com")])
    rows = docs.select("text", F.explode(needles).alias("needle"))
    return rows.groupBy("needle").agg(F.count_if(F.like("text", scalars.like_pattern(F.col("needle")))).alias("documents"))


@query("SELECT p_type AS prefix_of, count(*) AS n, count(*) FILTER (WHERE p_name LIKE '%_mall%') AS literal FROM part WHERE p_type LIKE 'S%' GROUP BY 1")
def prefix_categories(spark, sf_dir):
    """Categories by prefix, and how many of their names have a mark before ``mall``."""
    kept = table(spark, sf_dir, "part").filter(F.col("p_type").startswith("S"))
    return kept.groupBy(F.col("p_type").alias("prefix_of")).agg(F.count("*").alias("n"), F.count_if(F.col("p_name").like("%_mall%")).alias("literal"))


@query(
    """WITH e AS (SELECT event_id, nullif(event_type, 'error') AS now, lag(nullif(event_type, 'error')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT event_id, now, was FROM e WHERE now IS DISTINCT FROM was"""
)
def changed_states(spark, sf_dir):
    """Events whose state differs from the user's last, unknown being a state."""
    now = F.nullif(F.col("event_type"), F.lit("error"))
    was = F.lag(now).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", now.alias("now"), was.alias("was")).filter(~F.col("now").eqNullSafe(F.col("was")))


@query(
    "WITH t AS (SELECT DISTINCT name FROM items) SELECT t.name, x.lot_id, x.part, x.publish_date FROM t, LATERAL (SELECT lot_id, part, publish_date FROM items i WHERE i.name = t.name AND publish_date < DATE '2000-01-01' ORDER BY publish_date DESC, lot_id, part LIMIT 5) x",
    "lots items",
)
def newest_items(spark, sf_dir):
    """The five newest items of every name before a date."""
    items = History(spark, sf_dir, date(2000, 1, 1)).items().select("name", "lot_id", "part", "publish_date")
    return search.top(items, "name", [F.desc("publish_date"), "lot_id", "part"], 5).drop("place")


@query("SELECT o_orderkey AS lot_id, sha256('20:' || o_orderkey) AS sampling_key FROM orders")
def sampling_keys(spark, sf_dir):
    """The hash that orders a stratum's lots for a sample."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lot_id"), evaluation.sampling_key(20, F.col("o_orderkey")).alias("sampling_key"))


_SEALED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
_ROW = " || '|' || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _SEALED)
_LANES = ", ".join(f"sum(('0x' || substr(d, {8 * i + 1}, 8))::UBIGINT)::BIGINT AS l{i}" for i in range(sealed.LANES))


def _levels(n: int) -> str:
    """Levels of the twin's tree; one is part of it while the one below has more than one node."""
    one = "t{k} AS (SELECT {k} AS level, node // 16 AS node, sum(n_rows)::BIGINT AS n_rows, sha256(sum(n_rows)::BIGINT || '|' || string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM t{j} WHERE {k} = 1 OR (SELECT max(node) FROM t{j}) > 0 GROUP BY 2)"
    return ", ".join(one.format(k=k, j=k - 1) for k in range(1, n + 1))


@query(
    f"WITH r AS (SELECT l_orderkey // 1024 AS node, sha256({_ROW}) AS d FROM lineitem), s AS (SELECT node, count(*) AS n_rows, {_LANES} FROM r GROUP BY 1),"
    + f" t0 AS (SELECT 0 AS level, node, n_rows, sha256(n_rows || ':' || {chr(32) + '|| chr(58) ||'.join(f' l{i} ' for i in range(sealed.LANES))}) AS digest FROM s), {_levels(5)} "
    + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(6))
)
def sealed_lines(spark, sf_dir):
    """The tree of digests over the items, sealed beside the rows that were written in ranges of the lot."""
    return sealed.seal(table(spark, sf_dir, "lineitem"), folder(spark), "l_orderkey", _SEALED)


_FORGED = "l_orderkey % 4999 = 7 AND l_linenumber = 1"
_TAKEN = "l_orderkey % 701 = 3 AND l_linenumber = 2"


@query(
    f"""WITH o AS (SELECT {", ".join(_SEALED)} FROM lineitem), f AS (SELECT * REPLACE (CASE WHEN {_FORGED} THEN l_suppkey + 1 ELSE l_suppkey END AS l_suppkey) FROM o WHERE NOT ({_TAKEN})),
 u AS (SELECT *, -1 AS s FROM o UNION ALL SELECT *, 1 FROM f), b AS (SELECT {", ".join(_SEALED)}, sum(s) AS s FROM u GROUP BY ALL) SELECT CASE WHEN s > 0 THEN 'NEW' ELSE 'GONE' END AS change, {", ".join(_SEALED)}, abs(s)::BIGINT AS times FROM b WHERE s <> 0"""
)
def forged_lines(spark, sf_dir):
    """Items forged and taken away after sealing: the way down the trees finds
    the ranges, and only these are compared row by row."""
    rows, path = table(spark, sf_dir, "lineitem").select(*_SEALED), folder(spark)
    sealed.seal(rows, path, "l_orderkey", _SEALED)
    forged = rows.filter(f"NOT ({_TAKEN})").withColumn("l_suppkey", F.when(F.expr(_FORGED), F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")))
    return sealed.changed_rows(spark.read.parquet(f"{path}/rows"), forged, sealed.unsealed(forged, path), "l_orderkey", _SEALED)
