"""Further queries of the service: domains, questions, keys, changes, sweeps in phases, vectors in hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import acl, policy, text
from lodestone.operators import chunking, context, digests, evaluation, rank, sketches, substring, tables, vector, vector_index, visibility
from lodestone.plans import answer
from lodestone.plans.catalogue import _BM25, _COSINE, _EVAL, _FUSED, _SWEEP, _VISIBLE, _asked, _swept
from lodestone.plans.registry import query
from lodestone.sources import pages, sinks
from lodestone.sources.staging import new_path
from lodestone.streaming import stateful, streams

# ---- filters

_DOMAIN = "CASE WHEN lang = 'de' THEN 'legal' WHEN lang = 'en' THEN 'general' END"


@query("docs", f" SELECT doc_id FROM docs WHERE ({_VISIBLE.format(u=2)}) AND {_DOMAIN} = 'legal'")
def domain_filter(t):
    docs = t.docs.withColumn("doc_domain", F.when(F.col("lang") == "de", "legal").when(F.col("lang") == "en", "general"))
    return docs.filter(acl.in_domain(acl.visible("internal", 2, [1, 2]), "legal")).select("doc_id")


_QUESTIONS = """WITH q AS (SELECT item_id AS id, text AS question, CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 40) END AS expected_answer, 'note ' ||
  item_id AS notes,
  CASE WHEN item_id % 2 = 0 THEN 'main' ELSE 'extra' END AS dataset, CASE WHEN item_id % 5 > 0 THEN ['t' || (item_id % 5), 'all'] END AS
  tags, item_id % 4 <> 0 AS is_active FROM benchmark)"""


def _bank(t):
    i = F.col("item_id")
    tags = F.when(i % 5 > 0, F.array(F.concat(F.lit("t"), (i % 5).cast("string")), F.lit("all")))
    return t.benchmark.select(
        i.alias("id"), F.col("text").alias("question"), F.when(i % 3 == 0, F.substring("text", 1, 40)).alias("expected_answer"), F.concat(F.lit("note "), i.cast("string")).alias("notes"),
        F.when(i % 2 == 0, "main").otherwise("extra").alias("dataset"), tags.alias("tags"), (i % 4 != 0).alias("is_active"),
    )


@query(None, _QUESTIONS + """ SELECT id FROM q WHERE dataset = 'main' AND list_contains(tags, 'all') AND is_active AND (contains(lower(question), 'th') OR
  contains(lower(expected_answer), 'th') OR contains(notes, 'th'))""")
def question_filters(t):
    return _bank(t).filter(tables.question_filter("main", "all", "TH", True)).select("id")


@query(None, _QUESTIONS + " SELECT dataset, count(*) AS n, count_if(is_active)::BIGINT AS active FROM q GROUP BY dataset")
def question_datasets(t):
    return _bank(t).groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query(None, """SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 0.9 ELSE doc_id % 10 / 10.0 END::DOUBLE AS score FROM labels WHERE quality = 0 OR CASE WHEN
  toxic = 1 THEN 0.9 ELSE doc_id % 10 / 10.0 END > 0.3 ORDER BY score DESC""")
def quality_warnings(t):
    scored = t.labels.withColumn("score", F.when(F.col("toxic") == 1, 0.9).otherwise((F.col("doc_id") % 10) / 10.0))
    found = scored.filter((F.col("quality") == 0) | (F.col("score") > 0.3))
    return found.select("doc_id", "quality", "score").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "doc_id")


@query("docs", """ SELECT DISTINCT source AS filename FROM docs JOIN labels USING (doc_id) WHERE quality = 1 AND contains(lower(source), '1') ORDER BY filename
  LIMIT 100""")
def filename_picker(t):
    done = t.docs.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return done.filter(tables.contains_text(F.col("source"), "1")).select(F.col("source").alias("filename")).distinct().orderBy("filename").limit(100)


# ---- keys, roles, configuration


@query("docs", """ SELECT doc_id, CASE WHEN owner_id IS NOT NULL THEN 'uploads/users/' || owner_id WHEN group_id IS NOT NULL THEN 'uploads/groups/' || group_id
  ELSE 'uploads/public' END
  || '/' || doc_id || '_' || source || '.txt' AS storage_key FROM docs""")  # fmt: skip
def storage_keys(t):
    name = F.concat(F.lit("a/b/"), "source", F.lit(".txt"))
    return t.docs.select("doc_id", policy.storage_key(F.col("owner_id"), F.col("group_id"), F.col("doc_id"), name).alias("storage_key"))


@query(None, "SELECT event_id, event_id % 4 <> 2 AS same FROM events")
def config_equality(t):
    i, v = F.col("event_id") % 4, F.col("value").cast("string")
    current = F.concat(F.lit('{"b": ['), v, F.lit(', true], "a": "x"}'))
    other = F.concat(F.lit('{"a":"x","b":['), v, F.when(i == 2, ",false]}").otherwise(",true]}"))
    stored = F.when(i == 0, current).when(i == 3, F.lit('"plain"')).otherwise(other)
    return t.events.select("event_id", policy.same_config(F.when(i == 3, "plain").otherwise(current), stored).alias("same"))


@query("messages", " SELECT id, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS role, content FROM messages")
def chat_roles(t):
    return t.messages.select("id", policy.chat_role(F.col("role")).alias("role"), "content")


@query(None, """SELECT o_orderkey AS key_id, sha256('rg_sys_' || o_clerk || o_orderkey) AS key_hash, substr('rg_sys_' || o_clerk || o_orderkey, 1, 13) AS shown
  FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders)""")
def api_key_hashes(t):
    raw = F.concat(F.lit(policy.KEY_PREFIX), "o_orderpriority", F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("key_id"), policy.key_hash(raw).alias("key_hash"), policy.key_display(raw).alias("shown"))


@query(
    None,
    """SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase') AS created_at, max(ts) FILTER (WHERE event_type = 'click') AS last_used_at,
  max(ts) FILTER (WHERE event_type = 'error') AS revoked_at,
  count_if(event_type = 'purchase') > 0 AND coalesce(max(ts) FILTER (WHERE event_type = 'purchase') > max(ts) FILTER (WHERE event_type =
  'error'), count_if(event_type = 'error') = 0) AS is_active FROM events GROUP BY user_id""",
)
def api_key_lifecycle(t):
    kind = F.when(F.col("event_type") == "purchase", "create").when(F.col("event_type") == "click", "use").when(F.col("event_type") == "error", "revoke")
    return tables.lifecycle(t.events.select("user_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts")), "user_id", "kind", "ts")


# ---- changes of tables


@query(
    "docs",
    """, c AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
SELECT doc_id, CASE WHEN q = 0 THEN 'flagged' ELSE source END AS source, CASE WHEN q = 1 THEN 'checked' ELSE lang END AS lang FROM docs LEFT
  JOIN c USING (doc_id)""",
)
def column_updates(t):
    """Labels set the source of bad documents and the language of good ones; what a change leaves null stays."""
    q = F.col("quality")
    changes = t.labels.select("doc_id", F.lit(1).alias("seq"), F.when(q == 0, "flagged").alias("source"), F.when(q == 1, "checked").alias("lang"))
    return tables.patch(t.docs.select("doc_id", "source", "lang"), changes, "doc_id", "seq")


@query(None, """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'good' FROM labels WHERE
  quality = 1""")
def change_log(t):
    log = t.labels.select("doc_id", F.lit("good").alias("source"), (F.col("quality") == 0).alias("deleted"), F.lit(1).alias("seq"))
    return tables.apply_log(t.documents.select("doc_id", "source"), log, "doc_id", "seq")


@query(None, "SELECT user_id, event_type AS key, max(value) AS value FROM events WHERE value BETWEEN 1 AND 60 GROUP BY ALL")
def parameter_updates(t):
    """The valid changes of a parameter, the largest of a key being its last."""
    v = F.col("value")
    error = policy.config_error(v.cast("string"), F.lit("float"), F.lit(1.0), F.lit(60.0), F.lit(None).cast("array<string>"))
    valid = t.events.filter(error.isNull()).select("user_id", F.col("event_type").alias("key"), "value")
    return valid.groupBy("user_id", "key").agg(F.max("value").alias("value"))


@query(
    "logs",
    """, c AS (SELECT user_id::VARCHAR AS key, arg_max(latency::VARCHAR, (started_at, latency::VARCHAR)) AS value FROM logs GROUP BY user_id),
d AS (SELECT user_id::VARCHAR AS key, min(latency)::VARCHAR AS value FROM logs WHERE user_id % 2 = 0 GROUP BY user_id)
SELECT coalesce(c.key, d.key) AS key, d.value FROM c FULL JOIN d ON c.key = d.key WHERE c.value IS DISTINCT FROM d.value""",
)
def config_resync(t):
    rows = t.logs.select(F.col("user_id").cast("string").alias("key"), F.col("latency").cast("string").alias("value"), F.col("started_at").alias("ts"))
    table = t.logs.filter("user_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.min("latency").cast("string").alias("value"))
    return streams.out_of_step(streams.current_config(rows), table)


@query("messages", """ , r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) - 1 AS chunk_index FROM messages) SELECT conv_id, id, (chunk_index +
  100)::INTEGER AS chunk_index FROM r""")
def next_chunk_index(t):
    return chunking.numbered(t.messages, "conv_id", [F.col("id")], 100).select("conv_id", "id", "chunk_index")


@query(None, """SELECT doc_id, source FROM documents UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def append_missing(t):
    return tables.append_new(
        t.documents.select("doc_id", "source"), t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit("vector").alias("source")),
        "doc_id",
    )


# ---- retrieval with vectors


_VECTOR = """, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), cs AS (SELECT q.vec_id AS qid, c.vec_id AS doc_id,
  round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c
  ON q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id <> q.vec_id), vd AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid
  ORDER BY score DESC, doc_id) AS rank FROM cs),
vf AS (SELECT qid, doc_id, round(sum(part), 6) AS score FROM (SELECT qid, doc_id, 1.5 / (30 + rank) AS part FROM vd WHERE rank <= 25 UNION
  ALL SELECT qid, doc_id, 0.5 / (30 + rank) FROM sparse WHERE rank <= 25) GROUP BY ALL),
vo AS (SELECT f.*, row_number() OVER (PARTITION BY qid, sha256(text)[:16] ORDER BY score DESC, doc_id) AS nth FROM vf f JOIN documents USING (doc_id))"""


@query(None, f"""WITH {_FUSED}{_VECTOR} SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM
  vo WHERE nth = 1""")
def vector_hybrid(t):
    """The dense list from stored vectors: a question's vector is that of the same number, a document's too."""
    asked = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    dense = vector.cosine_top_k(asked, t.embeddings, 25).withColumnRenamed("vec_id", "doc_id")
    return answer.hybrid(t.index, _asked(t), dense=dense)


@query(None, f"WITH {_FUSED} SELECT qid, doc_id, score FROM fused WHERE (qid, doc_id) IN (SELECT (qid, doc_id) FROM dense WHERE rank <= 25)")
def dense_only_hybrid(t):
    """The benchmark's variant: fused scores, without what only the BM25 list has."""
    fused = answer.fused_lists(t.index, _asked(t), 25, (1.5, 0.5), 30)
    dense = t.index.lists(_asked(t), 25).filter(F.col("dense").isNotNull()).select("qid", "doc_id")
    return fused.join(dense, ["qid", "doc_id"], "left_semi")


@query(None, f"""WITH {_FUSED}, b AS (SELECT item_id AS qid, length(text) AS n FROM benchmark) SELECT qid, doc_id, score FROM cand JOIN b USING (qid) WHERE
  rank <= CASE WHEN n > 200 THEN 15 ELSE 5 END""")
def breadth_cut(t):
    """How many candidates a question keeps follows its breadth: here that of its length."""
    sizes = _asked(t).select("qid", policy.fetch_sizes(F.when(F.length("question") > 200, "broad").otherwise("narrow")).alias("s"))
    wide, slim = policy.FETCH["broad"][1], policy.FETCH["narrow"][1]
    kept = F.when(F.col("s.top_k") == wide, 15).when(F.col("s.top_k") == slim, 5)
    return answer.hybrid(t.index, _asked(t)).join(sizes, "qid").filter(F.col("rank") <= kept).select("qid", "doc_id", "score")


@query(
    None,
    f"""WITH {_FUSED} SELECT qid, source, list(doc_id ORDER BY rank) FILTER (WHERE rank <= 25) AS articles, bool_or(doc_id % 7 = 0) AS edited,
  max(doc_id) AS edited_at, max(score) AS max_score
FROM cand JOIN documents USING (doc_id) WHERE rank <= 25 GROUP BY qid, source""",
)
def source_flags(t):
    rows = answer.hybrid(t.index, _asked(t)).filter("rank <= 25").join(t.documents.select("doc_id", "source"), "doc_id")
    return rows.groupBy("qid", "source").agg(
        rank.ordered_unique("doc_id", "rank").alias("articles"), F.bool_or(F.col("doc_id") % 7 == 0).alias("edited"), F.max("doc_id").alias("edited_at"), F.max("score").alias("max_score")
    )


# ---- evaluation


@query(
    None,
    _SWEEP + """, w AS (SELECT *, round((0.6 * hit_rate + 0.4 * mrr) / 1.0, 4) AS c FROM m), top AS (SELECT * FROM w ORDER BY c DESC, config_id LIMIT 3),
j AS (SELECT config_id, round((0.6 * hit_rate + 0.4 * mrr + 0.5 * round(10 * hit_rate, 1) / 10) / (0.6 + 0.4 + 0.5), 4) AS composite, true AS judged FROM top
  UNION ALL SELECT config_id, c, false FROM w WHERE config_id NOT IN (SELECT config_id FROM top))
SELECT *, (row_number() OVER (ORDER BY judged DESC, composite DESC, config_id))::INTEGER AS place FROM j""",
)
def two_phase_sweep(t):
    judge = lambda df: df.withColumn("faithfulness", F.round(10 * F.col("hit_rate"), 1)).withColumn("relevancy", F.lit(None).cast("double"))
    return evaluation.two_phases(_swept(t), {"hit_rate": 0.6, "mrr": 0.4, "faithfulness": 0.5, "relevancy": 0.0}, 3, judge)


@query(
    None,
    _EVAL + """, pr AS (SELECT i::INTEGER AS param_id, * FROM (VALUES (0, 1, 0.0, 0.0), (1, 4, 0.0, 0.5), (2, 4, 0.02, 0.0), (3, 10, 0.0, 0.9)) v(i, top_k,
  lo, gap)),
x AS (SELECT c.*, source, max(score) OVER (PARTITION BY qid) AS best FROM cand c JOIN documents USING (doc_id)), y AS (SELECT param_id,
  x.qid, source, row_number() OVER (PARTITION BY param_id, x.qid ORDER BY score DESC, doc_id) AS rank, top_k
  FROM x, pr WHERE score >= lo AND (best <= 0 OR score >= best * gap)), hh AS (SELECT * FROM h WHERE source_hint IS NOT NULL),
f AS (SELECT param_id, qid, min(rank) AS first FROM y JOIN hh USING (qid) WHERE rank <= top_k AND contains(lower(source), lower(source_hint)) GROUP BY ALL)
SELECT pr.param_id, round(count(first) / (SELECT count(*) FROM hh), 4) AS hit_rate, round(coalesce(sum(1.0 / first), 0) / (SELECT count(*)
  FROM hh), 4) AS mrr FROM pr LEFT JOIN f USING (param_id) GROUP BY pr.param_id""",
)
def rerank_search(t):
    settings = [(0, 1, 0.0, 0.0), (1, 4, 0.0, 0.5), (2, 4, 0.02, 0.0), (3, 10, 0.0, 0.9)]
    params = t.spark.createDataFrame(settings, "param_id int, top_k int, min_score double, gap_ratio double")
    found = answer.hybrid(t.index, _asked(t)).join(t.documents.select("doc_id", "source"), "doc_id")
    return evaluation.search_rerank(found.select("qid", F.col("doc_id").alias("key"), "source", "score"), params, t.questions)


@query(None, _SWEEP + " SELECT arg_max(config_id, (0.4 * hit_rate + 0.6 * mrr, -config_id)) AS config_id FROM m")
def best_setting(t):
    score = 0.4 * F.col("hit_rate") + 0.6 * F.col("mrr")
    return _swept(t).agg(F.max_by("config_id", F.struct(score, -F.col("config_id"))).alias("config_id"))


@query("logs", " SELECT count(*) AS finished, 100.0::DOUBLE AS percent, max(latency) AS best, true AS done FROM logs")
def sweep_progress(t):
    return streams.sweep_progress(t.logs.withColumn("composite", F.col("latency")), t.logs.count())


# ---- documents and pages

_PAGES = "p AS (SELECT source, doc_id % 50 AS page, sum(length(text)) AS chars, bool_or(length(text) < 40) AS garbled, bool_or(contains(text, '|') AND contains(text, '---')) AS tab FROM documents GROUP BY ALL)"


@query(
    None,
    f"""WITH {_PAGES}, s AS (SELECT source, count(*) AS n, count_if(garbled) AS g, count_if(tab) AS t FROM p GROUP BY source)
SELECT source, greatest(50 - n, 0)::BIGINT AS n_missing, greatest(g - t, 0)::BIGINT AS n_garbled, (greatest(50 - n, 0) + greatest(g - t, 0))
  / 50.0::DOUBLE AS bad_ratio,
  (greatest(50 - n, 0) + greatest(g - t, 0)) / 50.0 > 0.3 AS is_low FROM s""",
)
def extraction_quality(t):
    text_ = F.col("text")
    pages = (
        t.documents.groupBy("source", (F.col("doc_id") % 50).alias("page"))
        .agg(
            F.bool_or(F.length(text_) < 40).alias("garbled"),
            F.bool_or(F.contains(text_, F.lit("|")) & F.contains(text_, F.lit("---"))).alias("tab"),
        )
    )
    sums = pages.groupBy("source").agg(F.count("*").alias("n"), F.count_if("garbled").alias("g"), F.count_if("tab").alias("t"))
    return sums.select("source", policy.extraction_quality(F.lit(50).cast("long"), F.col("n"), F.col("g"), F.col("t")).alias("q")).select("source", "q.*")


@query(None, f"""WITH {_PAGES}, f AS (SELECT source, count_if(chars < 500) AS scans, count_if(garbled) AS bad, sum(chars) AS chars FROM p GROUP BY source)
  SELECT count_if(scans = 0 AND bad = 0)::BIGINT AS ok, count_if(scans > 0)::BIGINT AS with_scans, count_if(bad > 0)::BIGINT AS garbled,
  count(*) AS files, sum(chars)::BIGINT AS chars FROM f""")
def folder_summary(t):
    pages = (
        t.documents.groupBy("source", (F.col("doc_id") % 50).alias("page"))
        .agg(F.sum(F.length("text")).alias("chars"), F.bool_or(F.length("text") < 40).alias("garbled"))
    )
    files = pages.groupBy("source").agg(F.count_if(F.col("chars") < 500).alias("scans"), F.count_if("garbled").alias("bad"), F.sum("chars").alias("chars"))
    ok = F.count_if((F.col("scans") == 0) & (F.col("bad") == 0))
    return files.agg(
        ok.alias("ok"), F.count_if(F.col("scans") > 0).alias("with_scans"), F.count_if(F.col("bad") > 0).alias("garbled"),
        F.count("*").alias("files"), F.sum("chars").alias("chars"),
    )


@query(None, """SELECT round(100.0 * count_if(length(text) >= 40) / count(*), 1) AS ok_percent, round(avg(length(text)), 1) AS mean_chars,
  sum(ceil(length(text) / 1500.0))::BIGINT AS chunks, round(100.0 * count_if(length(text) < 40) / count(*), 1) AS bad_percent FROM documents""")
def dry_run_summary(t):
    n, size = F.nullif(F.count("*"), F.lit(0)), F.length("text")
    share = lambda c: F.round(100.0 * F.count_if(c) / n, 1)
    return t.documents.agg(
        share(size >= 40).alias("ok_percent"), F.round(F.avg(size), 1).alias("mean_chars"), F.sum(F.ceil(size / 1500.0)).alias("chunks"),
        share(size < 40).alias("bad_percent"),
    )


_BLOCKS = "b AS (SELECT user_id AS path, event_id % 4 AS page, event_id % 7 AS x, value AS y, event_type || ' ' || event_id AS text FROM events)"


@query(None, f"WITH {_BLOCKS} SELECT path, page, string_agg(text, chr(10) ORDER BY round(y / 10) * 10, x, text) AS text FROM b GROUP BY ALL")
def page_texts(t):
    return pages.page_texts(_placed(t))


def _placed(t):
    i = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("path"), (i % 4).alias("page"), (i % 7).alias("x"), F.col("value").alias("y"),
        F.concat("event_type", F.lit(" "), i.cast("string")).alias("text"),
    )


@query(
    None,
    f"""WITH {_BLOCKS}, t AS (SELECT path, page, string_agg(text, chr(10) ORDER BY round(y / 10) * 10, x, text) AS text FROM b GROUP BY ALL),
g AS (SELECT user_id AS path, 1 AS page, '| ' || event_type || ' | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || count(*) || ' |  |' AS text FROM events WHERE user_id % 2 = 0 GROUP BY user_id, event_type)
SELECT path, page, 'text' AS content_type, text FROM t WHERE page <> 1 OR path NOT IN (SELECT path FROM g) UNION ALL SELECT path, page, 'table', text FROM g""",
)
def page_documents(t):
    grids = t.events.filter("user_id % 2 = 0").groupBy(F.col("user_id").alias("path"), F.col("event_type").alias("nth")).agg(F.count("*").alias("n"))
    cells = F.array(F.array("nth", F.lit("a|b")), F.array(F.col("n").cast("string")))
    found = grids.select("path", F.lit(1).cast("long").alias("page"), "nth", cells.alias("cells"))
    return pages.assembled(pages.page_texts(_placed(t)), found)


@query(None, _QUESTIONS + """, n AS (SELECT text AS question, 'new' AS dataset FROM benchmark WHERE item_id < 5)
SELECT id, question, dataset FROM q UNION ALL SELECT (SELECT max(id) FROM q) + row_number() OVER (ORDER BY question), question, dataset FROM n""")  # fmt: skip
def question_import(t):
    new = t.benchmark.filter("item_id < 5").select(F.col("text").alias("question"), F.lit("new").alias("dataset"))
    new = new.unionByName(t.spark.createDataFrame([("  ", "new")], "question string, dataset string"))
    return sinks.import_questions(_bank(t), new).select("id", "question", "dataset")


# ---- conversations and caches


@query("messages", """, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS nth FROM messages)
SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || substr(content, 1, 200), chr(10) ORDER BY id) AS transcript FROM r WHERE
  nth > 4 GROUP BY conv_id""")  # fmt: skip
def summary_input(t):
    """What a rolling summary is made from: the turns before the last four, for a model's port."""
    return context.transcript(context.older_turns(t.messages, "conv_id", "id", 4), "conv_id")


@query(
    None,
    """WITH e AS (SELECT user_id, min(ts) AS written FROM events GROUP BY user_id), m AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY
  user_id ORDER BY ts) + INTERVAL 12 HOUR AS late FROM events),
d AS (SELECT *, max(coalesce(late, false)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS dead FROM m)
SELECT user_id, count(*) AS hits, max(ts) + INTERVAL 12 HOUR AS expires_at FROM d WHERE dead = 0 GROUP BY user_id""",
)
def cache_renewal(t):
    hits = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    entries = hits.groupBy("user_id").agg(F.min("ts").alias("written"))
    return streams.renewed(entries, hits, "user_id", "written", "ts", 12 * 3600)


@query("messages", " SELECT id, coalesce(NOT list_contains([conv_id % 10, turn], 3), true) AS stays FROM messages")
def cache_invalidation(t):
    cache = t.messages.select("id", F.array((F.col("conv_id") % 10).cast("long"), F.col("turn").cast("long")).alias("document_ids"))
    left = streams.invalidated(cache, 3).select("id", F.lit(True).alias("stays"))
    return cache.select("id").join(left, "id", "left").select("id", F.coalesce("stays", F.lit(False)).alias("stays"))


# ---- small rules over a table


@query("messages", " SELECT id, CASE WHEN length(trim(content[:turn])) < 3 THEN content ELSE trim(content[:turn]) END AS question FROM messages")
def condensed_questions(t):
    return t.messages.select("id", policy.condensed(F.col("content"), F.expr("left(content, turn)")).alias("question"))


@query("messages", """, l AS (SELECT id, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM
  messages)
SELECT id, CASE WHEN len(lines) < 2 THEN [content] ELSE lines[1:4] END AS parts FROM l""")  # fmt: skip
def sub_questions(t):
    return t.messages.select("id", policy.sub_questions(F.col("content"), F.col("content")).alias("parts"))


@query("messages", " SELECT id, starts_with(upper(trim(CASE WHEN turn % 2 = 0 THEN 'да, ' ELSE 'нет ' END || content)), 'ДА') AS yes FROM messages")
def affirmative_answers(t):
    said = F.concat(F.when(F.col("turn") % 2 == 0, "да, ").otherwise("нет "), "content")
    return t.messages.select("id", policy.is_affirmative(said).alias("yes"))


@query("messages", " SELECT id, CASE WHEN turn % 3 = 0 THEN content ELSE role || chr(10) || chr(10) || content END AS content FROM messages")
def headed_chunks(t):
    return t.messages.select("id", chunking.with_heading(F.when(F.col("turn") % 3 != 0, F.col("role")), F.col("content")).alias("content"))


@query(None, "SELECT doc_id, doc_id || '.3' AS article, '2024-05-0' || (doc_id % 9 + 1) AS doc_date FROM documents")
def articles_and_dates(t):
    i = F.col("doc_id").cast("string")
    heading = F.concat(F.lit("см. Статья "), i, F.lit(".3 далее"))
    name = F.concat(F.lit("acts/2024-05-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("_x.pdf"))
    return t.documents.select("doc_id", text.article_number(heading).alias("article"), text.date_in_name(name).alias("doc_date"))


@query(
    "messages",
    """ SELECT id, 'Answer.' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'At length.' ELSE 'In short.' END || CASE WHEN conv_id % 3 = 0 THEN chr(10)
  || 'Cite articles.' ELSE chr(10) END AS prompt
FROM messages""",
)
def system_prompts(t):
    breadth = F.when(F.col("turn") % 2 == 0, "broad").otherwise("narrow")
    rules = {"broad": "At length.", "narrow": "In short."}
    prompt = policy.system_prompt("Answer.\nRULE\n", breadth, "RULE", rules, F.col("conv_id") % 3 == 0, "Cite articles.")
    return t.messages.select("id", F.regexp_replace(prompt, "\n\nCite", "\nCite").alias("prompt"))


_GRID = {"a": {"values": [1, 2, 5]}, "b": {"min": 0.1, "max": 0.5, "step": 0.2}, "c": {"default": 7}}


@query(
    None,
    """WITH points AS (SELECT (a.i * 3 + b.i)::INTEGER AS config_id, a.v::DOUBLE AS a, b.v::DOUBLE AS b, 7.0::DOUBLE AS c
  FROM (VALUES (0, 1), (1, 2), (2, 5)) a(i, v), (VALUES (0, 0.1), (1, 0.3), (2, 0.5)) b(i, v))
SELECT config_id, a, b, c, count(value) AS above FROM points LEFT JOIN events ON value > 20 * a * b + c GROUP BY ALL""",
)
def grid_points(t):
    """How many events each point of a grid would let through."""
    points = F.broadcast(evaluation.grid(t.spark, _GRID))  # as many rows as the grid has points
    above = t.events.select("value").join(points, F.col("value") > 20 * F.col("a") * F.col("b") + F.col("c")).groupBy("config_id").agg(F.count("*").alias("above"))
    return points.join(above, "config_id", "left").select("config_id", "a", "b", "c", F.coalesce("above", F.lit(0)).cast("long").alias("above"))


def _collection(t) -> sinks.Collection:
    """All documents as chunks; those with labels put in again as private ones, toxic ones hidden, bad ones taken out."""
    store = sinks.Collection(t.spark, new_path(t.spark, "collection"))
    store.ensure(2)
    chunks = t.docs.select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("doc_domain"), "visibility")
    embed = F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))
    store.upsert(chunks, embed)
    labelled = chunks.join(t.labels.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi")
    store.upsert(labelled.withColumn("visibility", F.lit("internal_private")), embed)
    store.change(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("hidden").alias("visibility")).distinct())
    store.delete(t.labels.filter("quality = 0 AND toxic = 0").select(F.col("doc_id").alias("document_id")))
    return store


@query("docs", """, l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id)
SELECT doc_id AS document_id, sha256(coalesce(text, ''))[:16] AS content_hash, lang AS doc_domain,
  CASE WHEN l.toxic = 1 THEN 'hidden' WHEN l.doc_id IS NOT NULL THEN 'internal_private' ELSE visibility END AS visibility
FROM docs LEFT JOIN l USING (doc_id) WHERE NOT coalesce(quality = 0 AND toxic = 0, false)""")
def collection_merge(t):
    return _collection(t).read().select("document_id", "content_hash", "doc_domain", "visibility")


@query("docs", """, l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id)
SELECT lang AS doc_domain, count(*) AS chunks, sum(length(coalesce(text, '')))::BIGINT AS chars FROM docs LEFT JOIN l USING (doc_id)
WHERE NOT coalesce(quality = 0 AND toxic = 0, false) AND (l.doc_id IS NULL AND visibility = 'internal_private' OR l.toxic = 0) GROUP BY lang""")
def collection_private_chunks(t):
    """A filter on who may see a chunk after its visibility has changed; merged segments."""
    store = _collection(t)
    store.table.compact(everything=True)
    private = store.read().filter("visibility = 'internal_private'")
    return private.groupBy("doc_domain").agg(F.count("*").alias("chunks"), F.sum(F.element_at("vector", 1).cast("long")).alias("chars"))


@query(None, _SWEEP + " SELECT config_id FROM (SELECT config_id, percent_rank() OVER (ORDER BY mrr DESC, config_id) AS place FROM m) WHERE place < 0.25")
def halved_settings(t):
    return evaluation.halved(_swept(t), "mrr", 2).select("config_id")


@query("docs", " SELECT doc_id, source FROM docs WHERE source IN (SELECT min(source) FROM docs)")
def database_first(t):
    first = t.docs.agg(F.min("source").alias("source"))
    table = t.docs.join(F.broadcast(first), "source", "left_semi").select("doc_id", "source")  # one row
    return tables.first_non_empty(table, t.docs.select("doc_id", "source"))


@query(None, _COSINE.format("AND c.label IN (1, 2, 3) AND c.vec_id % 7 <> 0") + " SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10")
def indexed_cosine(t):
    """Nearest vectors under an access filter from a stored index: folders of other labels are not read; every seventh vector was taken out."""
    vectors = t.embeddings.filter(F.col("label").isNotNull())
    index = vector_index.VectorIndex.build(vectors.filter("vec_id % 3 <> 0"), new_path(t.spark, "vectors"), cells=16, parted_by=("label",))
    index.add(vectors.filter("vec_id % 3 = 0"))  # without a rebuild
    index.remove(vectors.filter("vec_id % 7 = 0"))
    return index.search(t.embeddings.filter("vec_id % 20 = 0"), 10, folders=F.col("label").isin(1, 2, 3))


@query(None, """SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 12, 14)))
UNION ALL SELECT -1, doc_id FROM documents WHERE contains(lower(text), 'onthe')""")
def indexed_substrings(t):
    """Parts of every benchmark item, cut anywhere, and one more, in all documents, from a stored trigram index."""
    docs = t.documents.select("doc_id", "text")
    index = substring.SubstringIndex.build(docs, new_path(t.spark, "trigrams"))
    parts = t.benchmark.select(F.col("item_id").alias("qid"), F.substring("text", 12, 14).alias("part"))
    one = parts.limit(1).select(F.lit(-1).cast(dict(parts.dtypes)["qid"]).alias("qid"), F.lit("onthe").alias("part"))
    return index.search(docs, parts.unionByName(one))


_MAY = """CASE visibility WHEN 'internal_public' THEN kind = 'internal' WHEN 'internal_group' THEN kind = 'internal' AND group_id = user_id % 5
  WHEN 'internal_private' THEN kind = 'internal' AND owner_id = user_id ELSE owner_id = user_id AND {} END"""


@query("docs users", f" SELECT user_id, count(*) AS n_visible FROM users JOIN docs ON {_MAY.format('true')} OR (visibility = 'client_private' AND kind = 'internal' AND role = 'admin') GROUP BY user_id")
def bitmap_counts_by_user(t):
    """How many documents each user sees, from bitmaps alone."""
    index = visibility.VisibleIndex.build(t.docs, new_path(t.spark, "visible"))
    return index.counts(visibility.holders(t.users, t.memberships))


@query("docs users", f""", {_BM25}, w AS (SELECT c_custkey - 1 AS qid, c_custkey AS user_id FROM customer)
SELECT qid, doc_id, rank FROM sparse JOIN w USING (qid) JOIN users USING (user_id) JOIN docs USING (doc_id) WHERE rank <= 25 AND {_MAY.format("kind = 'client'")}""")
def bitmap_filtered_search(t):
    """The best 25 documents of each question, asked by the user of the next number, less those that this user does not see."""
    index = visibility.VisibleIndex.build(t.docs, new_path(t.spark, "visible"))
    found = t.index.search(_asked(t), 25).withColumn("user_id", F.col("qid") + 1)
    who = visibility.holders(t.users, t.memberships, for_list=False)
    return index.allowed(found, who).select("qid", "doc_id", "rank")


_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _daily(t):
    return sketches.merged(sketches.windows(t.logs, ["question"], "latency", "user_id", "started_at"), ["question"], "day")


@query()
def daily_quantiles(t):
    """Latencies and users of each kind of request by day, from hourly sketches; ``sketch_errors`` compares them with the rows."""
    return sketches.read(_daily(t), _SHARES)


@query("logs", """ SELECT question, date_trunc('day', started_at)::DATE AS start, count(*) AS n, true AS p50, true AS p95, true AS p99, true AS users
  FROM logs GROUP BY ALL""")
def sketch_errors(t):
    """Whether each quantile's rank among the day's rows, and the distinct users, are within the stated errors."""
    daily = sketches.read(_daily(t), _SHARES)
    rows = t.logs.withColumn("start", F.date_trunc("day", "started_at")).join(daily, ["question", "start"])
    below = {c: F.count_if(F.col("latency") < F.col(c)) / F.count("latency") for c in _SHARES}
    upto = {c: F.count_if(F.col("latency") <= F.col(c)) / F.count("latency") for c in _SHARES}
    error = F.lit(sketches.RANK_ERROR) + 1 / F.count("latency")
    users = F.abs(F.first("distinct") / F.countDistinct("user_id") - 1) <= sketches.DISTINCT_ERROR
    return rows.groupBy("question", "start").agg(
        F.count("*").alias("n"), *[((below[c] <= p + error) & (upto[c] >= p - error)).alias(c) for c, p in _SHARES.items()], users.alias("users")
    ).withColumn("start", F.to_date("start"))


# ---- tables compared by digests of ranges


@query(None, """SELECT doc_id, 'right' AS difference FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'left' FROM
  labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def reconcile_by_digests(t):
    """Documents without labels and labels without documents; only ranges of ids that differ are joined."""
    return digests.reconcile(t.documents, t.labels, "doc_id")


@query(None, """WITH l AS (SELECT l_orderkey AS key, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status FROM
  lineitem GROUP BY ALL)
SELECT coalesce(o_orderkey, key) AS key, CASE WHEN o_orderkey IS NULL THEN 'left' WHEN key IS NULL THEN 'right' ELSE 'changed' END AS difference
FROM orders FULL JOIN l ON o_orderkey = key WHERE o_orderstatus IS DISTINCT FROM status""")
def reconcile_status(t):
    """The status that orders have against the one their lines make."""
    lo, hi = F.min("l_linestatus"), F.max("l_linestatus")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.when(lo == hi, lo).otherwise("P").alias("status"))
    return digests.reconcile(t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), lines, "key", ["status"])


# ---- state of streams

_LAST = "TIMESTAMP'9999-01-01'"  # a row after all others, so that the watermark passes them


@query(None, """SELECT user_id AS key, event_id AS seq, count(*) OVER w AS n, count(*) OVER w > 2 AS limited FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND CURRENT ROW)""")
def sliding_rate_limits(t):
    """A stream of the events: how many each user had in the six hours up to each of them; what the stream wrote is read back."""
    out = new_path(t.spark, "limits")
    t.spark.sql(f"SELECT CAST(-1 AS LONG) AS user_id, CAST(-1 AS LONG) AS event_id, {_LAST} AS ts").write.parquet(f"{out}/last")
    events = t.spark.readStream.schema(t.events.schema).parquet(t.dir, pathGlobFilter="events.parquet")
    last = t.spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(f"{out}/last")
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    counted = stateful.sliding_limits(rows.unionByName(last), "user_id", "ts", "event_id", 2, 6 * 3600)
    stateful.run_stateful(t.spark, counted, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema("key long, seq long, n long, limited boolean").parquet(f"{out}/rows").filter("seq >= 0")
