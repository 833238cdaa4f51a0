"""The queries of the operators over their whole tables, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import archives, extraction, infilling, licenses, line_dedup, mixing, mtree, ngram_join, packing, quality, simhash, token_files, vector_codes
from lodestone.llm._common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return mtree.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_digests(docs, min_docs=10, min_chars=1, keep_first=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048, end_id=0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.RULES
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archives.write_warc(_table(spark, sf_dir, "pages"), path)
    return archives.read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens.orc")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return token_files.digests(token_files.read_tokens(spark, path))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.word_count(F.col("text")), mixing.quality_weight(F.col("text")))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", parts=8, entries=16, rounds=6, scale=4096)
    found = vector_codes.with_label_error(codes, "label")
    return found.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = infilling.fill_in_middle(_table(spark, sf_dir, "documents"), percent=90, spm_percent=20, seed=1)
    again = infilling.restored(F.col("output"), F.col("form"))
    return texts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


_ALL = (
    op1_top_k, op2_line_dedup, op3_simhash, op4_pack, op5_quality, op6_warc, op7_licenses, op8_token_files, op9_mix, op10_extract,
    op11_vector_codes, op12_ngram_join, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}


def _codebook_rounds(parts: int, width: int, entries: int, rounds: int) -> str:
    """A chain of expressions for ``op11_``: codebooks and assignments, round by round."""
    book = f"""
b0 AS MATERIALIZED (
  SELECT p.part, s.entry, p.x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) s USING (vec_id)),"""
    for k in range(rounds + 1):
        book += f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best, any_value(x) AS x FROM (
    SELECT p.vec_id, p.part, b.entry, p.x, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b USING (part))
  GROUP BY vec_id, part),"""
        if k < rounds:
            sums = ", ".join(f"sum(x[{j}])::BIGINT" for j in range(1, width + 1))
            book += f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, CASE WHEN n IS NULL THEN b.x ELSE list_transform(s, lambda v: (v - (v % n + n) % n) // n) END AS x
  FROM b{k} b LEFT JOIN (SELECT part, best.entry AS entry, count(*) AS n, [{sums}] AS s FROM a{k} GROUP BY ALL) USING (part, entry)),"""
    return book


ORACLES = {
    "op11_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[8 * part + 1 : 8 * part + 8] AS x FROM kept, range(8) t(part)),{_codebook_rounds(8, 8, 16, 6)}
sha AS (
  SELECT sha256(string_agg(x.v::VARCHAR, ',' ORDER BY part, entry, x.j)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(list_transform(b6.x, lambda v, j: struct_pack(v := v, j := j))) AS x FROM b6)),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha""",
    "op12_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS g
  FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM grams),
s AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM grams),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n_shingles + ny.n_shingles - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, b.y FROM reach r JOIN ends b ON b.x = r.to_id)
SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, substr(text, 1, least(c1, c2)) AS pre, substr(text, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid,
    substr(text, greatest(c1, c2) + 1) AS suf
  FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c""",
    "op1_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op9_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(1.0::DOUBLE / (1.0 + 8.0 * (length(text) - length(regexp_replace(text, '[#*$%&|<>!]+', '', 'g'))) / greatest(length(text), 1)), 1.0)::DOUBLE AS w
  FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS place, 3 * source_size AS lim, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT rest::DOUBLE / weights AS level FROM r WHERE lim * weights >= rest * weight ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, least(lim::DOUBLE, level * weight) AS target,
    CASE WHEN source_size > 0 THEN floor(least(lim::DOUBLE, level * weight) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM r, l),
c AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before + size / 2.0 < budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op2_line_dedup": r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, hash(text) AS text_hash FROM documents),
lines AS (
  SELECT rid, doc_id, text_hash, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(11) || chr(12) || chr(13) || chr(32)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
-- rows of one doc_id with different texts are documents of their own, repeated rows are one
heavy AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT (doc_id, text_hash)) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(h.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN heavy h ON keyed.k = h.k GROUP BY rid, doc_id""",
}
