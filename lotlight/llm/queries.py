"""Thin queries over the operators of this subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontam, html_text, langid, lm, merkle, mix, near_dup, packing, pii, quality, token_files, url_filter
from .shared import read, tune


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return html_text.extract(read(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled(spark))
    return url_filter.judge(read(spark, sf_dir, "pages"), model)


#: The queries' key; a real one comes from a secret store.
PII_KEY = "lotlight test key"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pii.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    return langid.label(docs, langid.train(docs))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    packed = packing.pack(read(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    back = token_files.write_and_read(read(spark, sf_dir, "documents"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, threshold=80)


def op9_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return lm.score(read(spark, sf_dir, "documents"))


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = quality.judge(read(spark, sf_dir, "documents"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*names, "n_lines", "distance")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return mix.taken(read(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return align.scored(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    rows, tiers = merkle.manifest(read(spark, sf_dir, "documents"), changed=merkle.tampered())
    return merkle.prove(rows, tiers, "changed")


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_main_text, op2_url_filter, op3_pii_surrogates, op4_language_crf, op5_best_fit_packing, op6_token_id_files, op7_benchmark_decontamination, op8_minhash_near_dup, op9_pitman_yor_lm, op10_quality_outliers, op11_source_mix, op12_tokenizer_alignment, op13_merkle_manifest)}


#: Exact links by shared shingles and their components by recursion.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc, a AS found FROM e UNION SELECT r.doc, e.b FROM r JOIN e ON e.a = r.found),
c AS (SELECT doc, min(found) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc = d.doc_id
"""


#: Trees by levels; a node's siblings by windows over its run; CRC-32 bit by bit.
OP13_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) AS row_no, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END).array_to_string('') AS head FROM documents),
hashed AS (SELECT *, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, replace(text, chr(10), '') AS short FROM leaves),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (SELECT source, 0 AS level, i, n, leaf AS h FROM numbered UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
every AS (SELECT true AS below, source, level, i, h FROM nodes WHERE n > 1 UNION ALL SELECT false, NULL, level, i, h FROM top WHERE n > 1),
sides AS (SELECT below, source, level, i,
    coalesce(string_agg(h, '') OVER (PARTITION BY below, source, level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY below, source, level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM every),
steps AS (
  SELECT row_no, s.level AS step, l, r FROM numbered d JOIN sides s ON below AND s.source IS NOT DISTINCT FROM d.source AND s.i = d.i // (3 ** s.level)::BIGINT
  UNION ALL SELECT row_no, 1000 + s.level, l, r FROM numbered d JOIN subroots t ON t.source IS NOT DISTINCT FROM d.source JOIN sides s ON NOT below AND s.i = t.i // (3 ** s.level)::BIGINT),
paths AS (SELECT row_no, string_agg(l || r, '' ORDER BY step) AS proof, list(l || '|' || r ORDER BY step) AS path FROM steps GROUP BY row_no),
changed AS (SELECT d.*, coalesce(proof, '') AS proof, coalesce(path, []) AS path, CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 2 = 1
    THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(short) || ':' || short END) ELSE leaf END AS found FROM numbered d LEFT JOIN paths USING (row_no)),
folded AS (SELECT *, list_reduce(list_prepend(found, path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM changed),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified, (strlen(proof) // 64)::INT AS n_siblings
FROM folded f JOIN subroots t ON t.source IS NOT DISTINCT FROM f.source CROSS JOIN root
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash_near_dup": OP8_SQL, "op13_merkle_manifest": OP13_SQL}
