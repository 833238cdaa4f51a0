"""The catalogue: a query per operator over the test tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import acl, policy, text, tokens
from lodestone.operators import bm25, chunking, context, evaluation, rank, tables, vector
from lodestone.plans import answer
from lodestone.plans.derived import Tables
from lodestone.plans.registry import ORACLES, QUERIES, query
from lodestone.sources.staging import new_path
from lodestone.streaming import streams

__all__ = ["ORACLES", "QUERIES"]

# ---- who sees what

_VISIBLE = "visibility = 'internal_public' OR (visibility = 'internal_private' AND owner_id = {u}) OR (visibility = 'internal_group' AND group_id IN (1, 2))"


@query("docs", f" SELECT doc_id, source FROM docs WHERE {_VISIBLE.format(u=2)}")
def acl_visible_docs(t):
    return t.docs.filter(acl.visible("internal", 2, [1, 2])).select("doc_id", "source")


@query("docs", f" SELECT doc_id FROM docs WHERE {_VISIBLE.format(u=1)} OR visibility = 'client_private'")
def acl_admin_list(t):
    return t.docs.filter(acl.visible("internal", 1, [1, 2], for_list=True, role="admin")).select("doc_id")


@query("docs", " SELECT doc_id FROM docs WHERE visibility = 'client_private' AND owner_id = 3")
def acl_client_docs(t):
    return t.docs.filter(acl.visible("client", 3, [])).select("doc_id")


@query(
    "docs users",
    """, d AS (SELECT visibility, owner_id, group_id, count(*) AS n FROM docs GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n_visible FROM users JOIN d ON CASE visibility WHEN 'internal_public' THEN kind = 'internal'
  WHEN 'internal_group' THEN kind = 'internal' AND group_id = user_id % 5 WHEN 'internal_private' THEN kind = 'internal' AND owner_id = user_id
  ELSE owner_id = user_id OR (kind = 'internal' AND role = 'admin') END GROUP BY user_id""",
)
def acl_counts_by_user(t):
    # documents are counted per owner, group and in all first, so users meet counts by equal keys and no document
    docs, vis = t.docs, F.col("visibility")
    by_owner = (
        docs.filter(vis.isin(acl.PRIVATE, acl.CLIENT)).groupBy(F.col("owner_id").alias("user_id"))
        .agg(F.count_if(vis == acl.PRIVATE).alias("own"), F.count_if(vis == acl.CLIENT).alias("mine"))
    )
    by_group = docs.filter(vis == acl.GROUP).groupBy("group_id").agg(F.count("*").alias("shared"))
    totals = docs.agg(F.count_if(vis == acl.PUBLIC).alias("public"), F.count_if(vis == acl.CLIENT).alias("clients"))
    users = t.users.withColumn("group_id", F.col("user_id") % 5).join(by_owner, "user_id", "left").join(by_group, "group_id", "left").crossJoin(F.broadcast(totals))  # one row
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    internal = n("public") + n("own") + n("shared") + F.when(F.col("role") == "admin", n("clients")).otherwise(n("mine"))
    return users.select("user_id", F.when(F.col("kind") == "client", n("mine")).otherwise(internal).alias("n_visible")).filter("n_visible > 0")


@query("docs", """ SELECT doc_id, coalesce(visibility = 'internal_public' OR (visibility = 'internal_group' AND group_id = 3) OR (visibility IN
  ('internal_private', 'client_private') AND owner_id = 8), false) AS can_view FROM docs""")
def acl_row_check(t):
    return t.docs.select(
        "doc_id",
        acl.can_view(F.col("visibility"), F.col("owner_id"), F.col("group_id"), F.lit("internal"), F.lit(8), F.array(F.lit(3)), F.lit("user")).alias("can_view"),
    )


@query(
    "docs",
    """ SELECT doc_id, CASE WHEN visibility = 'internal_public' THEN 'admin_only' WHEN visibility = 'client_private' THEN 'admin_only'
  WHEN visibility = 'internal_group' AND group_id NOT IN (1, 2) THEN 'not_a_member' END AS error, CASE WHEN doc_id % 4 >= 2 THEN 7 END::BIGINT AS owner,
  CASE WHEN visibility = 'internal_group' THEN group_id END AS grp FROM docs""",
)
def acl_placement(t):
    error = acl.placement_error(F.col("visibility"), F.col("group_id"), F.lit("internal"), F.lit("user"), F.array(F.lit(1), F.lit(2)))
    return t.docs.select(
        "doc_id", error.alias("error"), acl.owner_for(F.col("visibility"), F.lit(7).cast("long")).alias("owner"),
        acl.group_for(F.col("visibility"), F.col("group_id")).alias("grp"),
    )


# ---- search in text


@query("docs", f""" SELECT doc_id FROM docs WHERE ({_VISIBLE.format(u=2)}) AND regexp_matches(text, '(?i)(^|[^0-9A-Za-z_À-ÿ])for the(?:$|[^0-9A-Za-z_À-ÿ])')""")
def exact_phrase_search(t):
    return t.docs.filter(acl.visible("internal", 2, [1, 2]) & tables.phrase(F.col("text"), "for the")).select("doc_id")


@query(None, "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion_a%') OR contains(lower(text), 'onthe')")
def icontains_search(t):
    return t.documents.filter(tables.contains_text(F.col("text"), "tion_a%") | tables.contains_text(F.col("text"), "onthe")).select("doc_id")


@query("questions", " SELECT qid, question, source_hint FROM questions")
def question_hints(t):
    return t.questions


@query(None, "SELECT item_id AS qid, doc_id, source FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def trigram_prefilter(t):
    from lodestone.plans.derived import phrase_join

    return phrase_join(t.index, t.documents.select("doc_id", "text", "source"), t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("probe")))


@query(None, "SELECT doc_id, regexp_replace(text, '(?i)(ing)', '<mark>\\1</mark>', 'g') AS marked FROM documents WHERE contains(lower(text), 'ing')")
def search_highlight(t):
    return t.documents.filter(tables.contains_text(F.col("text"), "ing")).select("doc_id", text.highlighted(F.col("text"), "ing").alias("marked"))


# ---- conversations, logs, jobs


@query("messages", """ SELECT conv_id, arg_min(content, id) FILTER (WHERE role = 'user') AS first_question, count(*) AS n_messages, max(id) AS last_id FROM
  messages GROUP BY conv_id""")
def conversation_list(t):
    return tables.conversations(t.messages)


_TURNS = """, said AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS nth FROM messages WHERE length(trim(content, ' ')) >= 3),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS back FROM said WHERE NOT (nth = 1 AND role = 'user'))"""


@query("messages", _TURNS + """ SELECT conv_id, id, role, content, (row_number() OVER (PARTITION BY conv_id ORDER BY id))::INTEGER AS position FROM kept WHERE back <= 8""")
def history_window(t):
    return context.recent_turns(t.messages, "conv_id", "id", 8).select("conv_id", "id", "role", "content", "position")


@query("messages", _TURNS + """ SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || substr(content, 1, 200), chr(10) ORDER BY id) AS transcript FROM kept WHERE
  back <= 8 GROUP BY conv_id""")
def history_transcript(t):
    return context.transcript(context.recent_turns(t.messages, "conv_id", "id", 8), "conv_id")


@query("messages", " SELECT conv_id, arg_max(role, id) = 'user' AS drop_last FROM messages GROUP BY conv_id")
def trailing_user_drop(t):
    return t.messages.groupBy("conv_id").agg((F.max_by("role", "id") == "user").alias("drop_last"))


@query("messages", " SELECT conv_id, count(*) AS n FROM messages GROUP BY conv_id HAVING count(*) >= 8")
def summary_due(t):
    return t.messages.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n >= 8")


@query("logs", """ SELECT id, question, latency FROM logs WHERE question LIKE '%i%' AND started_at BETWEEN '2024-01-05' AND '2024-01-20 12:00:00' AND user_id
  IN (7, 8, 9)""")
def chat_log_filter(t):
    when = F.col("started_at").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return (
        t.logs.filter(tables.matching([tables.contains_text(F.col("question"), "i"), when, F.col("user_id").isin(7, 8, 9), None]))
        .select("id", "question", "latency")
    )


@query("logs", " SELECT status, count(*) AS n FROM logs GROUP BY status")
def job_status_counts(t):
    return t.logs.groupBy("status").agg(F.count("*").alias("n"))


@query("logs", """ SELECT count(*) AS total, count_if(status IN ('pending', 'running'))::BIGINT AS active, count_if(status = 'done')::BIGINT AS done,
  count_if(status = 'failed')::BIGINT AS failed FROM logs""")
def active_count(t):
    return t.logs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("pending", "running")).alias("active"),
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


@query("logs", " SELECT id FROM logs WHERE status = 'running' AND started_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 15 MINUTE")
def orphan_jobs(t):
    return tables.orphaned(t.logs, F.lit("2024-01-30 12:00:00").cast("timestamp"), 15).select("id")


@query("logs", " SELECT id, status FROM logs WHERE started_at >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY")
def old_job_cleanup(t):
    return t.logs.filter(F.col("started_at") >= F.lit("2024-01-30").cast("timestamp") - F.make_interval(days=F.lit(14))).select("id", "status")


@query("logs", " SELECT user_id, arg_max(status, (started_at, id)) AS status, max(started_at) AS at FROM logs GROUP BY user_id")
def latest_per_key(t):
    return (
        tables.latest(t.logs.select("user_id", "started_at", "id", "status"), ["user_id"], ["started_at", "id"])
        .select("user_id", "status", F.col("started_at").alias("at"))
    )


@query("logs", " SELECT id, started_at FROM logs ORDER BY started_at DESC, id LIMIT 20 OFFSET 40")
def pagination(t):
    return tables.page(t.logs, [F.desc("started_at"), F.col("id")], 20, 40).select("id", "started_at")


@query("logs", " SELECT id, question FROM logs WHERE status = 'failed' AND contains(question, 'err') ORDER BY started_at DESC, id LIMIT 200")
def recent_log_lines(t):
    return (
        tables.page(
            t.logs.filter((F.col("status") == "failed") & F.contains("question", F.lit("err"))), [F.desc("started_at"), F.col("id")], 200,
        )
        .select("id", "question")
    )


# ---- documents and relations


@query("docs", " SELECT DISTINCT source FROM docs WHERE contains(lower(source), '1')")
def distinct_sources(t):
    return t.docs.filter(tables.contains_text(F.col("source"), "1")).select("source").distinct()


@query(None, "SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0 OR l.toxic = 1")
def quality_flagged(t):
    return t.documents.select("doc_id").join(t.labels.filter((F.col("quality") == 0) | (F.col("toxic") == 1)), "doc_id")


@query("users memberships", " SELECT group_id, user_id, name FROM memberships JOIN users USING (user_id)")
def group_members(t):
    return t.memberships.join(t.users, "user_id").select("group_id", "user_id", "name")


@query("users", """ SELECT o_orderkey AS key_id, user_id FROM orders JOIN users ON o_custkey = user_id WHERE o_orderstatus <> 'F' AND kind = 'internal'""")
def api_key_lookup(t):
    return (
        t.orders.filter(F.col("o_orderstatus") != "F")
        .join(t.users.filter(F.col("kind") == "internal"), F.col("o_custkey") == F.col("user_id"))
        .select(F.col("o_orderkey").alias("key_id"), "user_id")
    )


@query(None, """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON
  c_nationkey = n_nationkey GROUP BY n_name""")
def order_customer_join(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(None, """SELECT doc_id, 'right' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'left' FROM
  labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def reconcile_both(t):
    return tables.differences(t.documents, t.labels, "doc_id")


@query(None, "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def reconcile_orphans(t):
    return t.embeddings.select("vec_id").join(t.documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query(None, "SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def reconcile_missing(t):
    return t.documents.select("doc_id").exceptAll(t.embeddings.select(F.col("vec_id").alias("doc_id")))


@query(None, """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality, -1)::INTEGER AS quality, d.source FROM (SELECT doc_id, source FROM
  documents) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def full_outer_sync(t):
    base = t.documents.select("doc_id", F.lit(-1).alias("quality"), "source")
    return tables.upsert(base, t.labels.select("doc_id", "quality", F.lit(None).cast("string").alias("source")), ["doc_id"])


@query(None, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'relabelled' FROM labels")
def replace_chunks(t):
    return tables.replace_groups(t.documents.select("doc_id", "source"), t.labels.select("doc_id", F.lit("relabelled").alias("source")), "doc_id")


@query(None, "SELECT sha256(text)[:16] AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(t):
    return t.documents.groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(None, "SELECT source, lang, sha256(text)[:16] AS hash, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_check(t):
    return tables.duplicates(t.documents.select("source", "lang", text.content_hash(F.col("text")).alias("hash")), ["source", "lang", "hash"])


@query(None, """SELECT doc_id, CASE WHEN nth = 0 THEN source || '.txt' ELSE source || ' (' || nth || ').txt' END AS unique_name FROM (SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM documents)""")
def unique_filenames(t):
    named = t.documents.select("doc_id", F.concat("source", F.lit(".txt")).alias("filename"))
    return tables.unique_names(named, "filename", "doc_id").select("doc_id", "unique_name")


@query(None, """SELECT source, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(max(doc_id), -1) AS last_id FROM documents GROUP BY
  source""")
def source_stats(t):
    return (
        t.documents.groupBy("source")
        .agg(
            F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
            F.coalesce(F.max("doc_id"), F.lit(-1)).alias("last_id"),
        )
    )


@query(None, """SELECT r_name, n_name, count(*) AS n, round(avg(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region
  ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_rollup(t):
    j = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 2).alias("balance"))


@query(None, """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    lines = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return (
        lines.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.count("*").alias("n"),
        )
    )


# ---- text


@query(None, r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '[^\S\n]+', ' ', 'g'), '(?m)^[•\-=~*]{3,}[ ]*$', '', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents""")
def clean_text(t):
    return t.documents.select("doc_id", text.clean_extracted(F.col("text")).alias("clean"))


_MARKDOWN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[([^\]]*)\]\(([^)]+)\)', '[image: \1](\2)', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '[*_`~]+', '', 'g')"
_ENTITIES_SQL = "{0}"
for _name, _char in text.ENTITIES:
    _ENTITIES_SQL = f"replace({_ENTITIES_SQL}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(None, "SELECT doc_id, regexp_replace(" + _ENTITIES_SQL.replace("{0}", _MARKDOWN) + r", '^\s+|\s+$', '', 'g') AS plain FROM documents")
def strip_markdown(t):
    return t.documents.select("doc_id", text.strip_markdown(F.col("text")).alias("plain"))


@query(None, r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def html_to_text(t):
    gone = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    return t.pages.select("page_id", F.trim(F.regexp_replace(F.regexp_replace(gone, "<[^>]*>", " "), r"\s+", " ")).alias("plain"))


@query(None, """SELECT doc_id, len(regexp_extract_all(lower(text), '[a-zа-яё0-9]{2,}'))::BIGINT AS n_tokens,
  len(list_distinct(regexp_extract_all(lower(text), '[a-zа-яё0-9]{2,}')))::BIGINT AS n_distinct FROM documents""")
def tokenize_counts(t):
    raw = t.documents.select("doc_id", tokens.tokenize_raw(F.col("text")).alias("raw"))
    return raw.select("doc_id", F.size("raw").cast("long").alias("n_tokens"), F.size(F.array_distinct("raw")).cast("long").alias("n_distinct"))


_STEM = "CASE WHEN regexp_matches(raw, '^[\\x00-\\x7F]*$') THEN regexp_replace(raw, '^(.{3,}?)(" + "|".join(tokens.LATIN_ENDINGS) + ")$', '\\1') WHEN regexp_matches(raw, '^[а-яё]') AND length(raw) >= 5 THEN regexp_replace(raw, '^(.{3,}?)(" + "|".join(tokens.RUSSIAN_ENDINGS) + ")$', '\\1') ELSE raw END"
_TOKENS = f"tok AS (SELECT doc_id, dl, {_STEM} AS token FROM (SELECT doc_id, len(raws) AS dl, unnest(raws) AS raw FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zа-яё0-9]{{2,}}') AS raws FROM documents)))"


@query(None, f"WITH {_TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY token")
def stem_tokens(t):
    posts = bm25.postings(t.documents)
    return posts.groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query(None, "SELECT count(*) AS n_docs, avg(len(regexp_extract_all(lower(text), '[a-zа-яё0-9]{2,}'))) AS avgdl FROM documents")
def doc_len_stats(t):
    return bm25.corpus_stats(t.documents)


_READABLE = r"""length(regexp_replace(text, '[^\p{L}\p{N} .,;:!?\-—\n\t()\[\]«»"'']', '', 'g'))"""


@query(None, f"""SELECT doc_id, round({_READABLE} / nullif(length(text), 0), 6) AS readable, NOT (contains(text, '|') AND contains(text, '---')) AND
  coalesce({_READABLE} / nullif(length(text), 0) < 0.6, false) AS garbled FROM documents""")
def garbled_ratio(t):
    return t.documents.select("doc_id", F.round(text.readable_share(F.col("text")), 6).alias("readable"), text.is_garbled(F.col("text")).alias("garbled"))


@query(None, f"""SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 50 THEN 'scan' WHEN NOT (contains(text, '|') AND contains(text, '---'))
  AND {_READABLE} / length(text) < 0.6 THEN 'garbled' ELSE 'text' END AS page_class, count(*) AS n, sum(length(text))::BIGINT AS chars FROM
  documents GROUP BY 1""")
def page_class_counts(t):
    return t.documents.groupBy(text.page_class(F.col("text")).alias("page_class")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_ADVICE = f""", p AS (SELECT *, doc_id // 10 AS page, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 50 THEN 'scan' WHEN NOT (contains(text, '|') AND contains(text, '---')) AND {_READABLE} / length(text) < 0.6 THEN 'garbled' ELSE 'text' END AS c FROM documents),
a AS (SELECT source, count(*) AS total, count_if(c <> 'text') AS bad, count_if(c = 'scan') AS scans, count_if(c = 'garbled') AS garbled,
  min(page) FILTER (WHERE c <> 'text') AS f, max(page) FILTER (WHERE c <> 'text') AS l FROM p GROUP BY source)
SELECT source, total, bad::BIGINT AS bad, CASE WHEN bad / total <= 0.1 THEN 'ok' WHEN garbled > scans AND garbled > 0 THEN 'encoding' WHEN f
  >= l - bad + 1 AND bad / total <= 0.5 THEN 'tail' WHEN bad / total <= 0.15 THEN 'pages' ELSE 'reconvert' END AS advice FROM a"""


@query(None, "WITH x AS (SELECT 1)" + _ADVICE)
def page_advice(t):
    pages = t.documents.select("source", F.floor(F.col("doc_id") / 10).alias("page"), text.page_class(F.col("text")).alias("c"))
    bad = F.col("c") != "text"
    sums = pages.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(bad).alias("bad"), F.count_if(F.col("c") == "scan").alias("scans"), F.count_if(F.col("c") == "garbled").alias("garbled"),
        F.min(F.when(bad, F.col("page"))).alias("first_bad"), F.max(F.when(bad, F.col("page"))).alias("last_bad"),
    )
    return sums.select(
        "source", "total", "bad",
        policy.page_advice(*[F.col(c) for c in ("total", "bad", "scans", "garbled", "first_bad", "last_bad")]).alias("advice"),
    )


def _hits(patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in patterns)


@query(None, f"""SELECT doc_id, round(({_hits(policy.LEGAL_MARKERS)}) / greatest(length(text) / 1000, 1.0), 6) AS density, CASE WHEN
  ({_hits(policy.LEGAL_MARKERS)}) / greatest(length(text) / 1000, 1.0) >= 1 THEN 'legal' ELSE 'general' END AS domain FROM documents""")
def domain_density(t):
    return t.documents.select(
        "doc_id", F.round(policy.marker_density(F.col("text")), 6).alias("density"), policy.document_domain(F.col("text")).alias("domain"),
    )


def _any(c: str, patterns: list[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join('(?:' + p.replace(chr(92) + 'w', '[0-9A-Za-z_а-яё]') + ')' for p in patterns)}')"


@query(
    "messages",
    f""" SELECT id, CASE WHEN {_any("lower(content)", policy.NARROW)} THEN 'narrow' WHEN {_any("lower(content)", policy.BROAD)} THEN 'broad' ELSE
  'narrow' END AS breadth,
  {_any("lower(content)", policy.COMPOUND)} AS compound, CASE WHEN {_any("lower(content)", policy.LEGAL_QUESTION)} THEN 'legal' ELSE
  'general' END AS domain FROM messages""",
)
def question_breadth(t):
    q = F.col("content")
    return t.messages.select(
        "id", policy.question_breadth(q).alias("breadth"), policy.needs_decomposition(q).alias("compound"),
        policy.question_domain(q).alias("domain"),
    )


@query("messages", f""" SELECT id, regexp_matches(content, '(?i){policy.EXACT_REFERENCE}') AS exact, CASE WHEN regexp_matches(content,
  '(?i){policy.EXACT_REFERENCE}') THEN 1.25 ELSE 0.5 END::DOUBLE AS weight FROM messages""")
def exact_ref_flag(t):
    return t.messages.select("id", policy.has_exact_reference(F.col("content")).alias("exact"), policy.sparse_weight(F.col("content"), 0.5).alias("weight"))


@query("messages", " SELECT role, avg(CASE WHEN " + " OR ".join(f"contains(lower(content), '{p}')" for p in policy.NOT_FOUND) + " THEN 1.0 ELSE 0.0 END) AS not_found FROM messages GROUP BY role")
def not_found_rate(t):
    return t.messages.groupBy("role").agg(F.avg(policy.is_not_found(F.col("content")).cast("double")).alias("not_found"))


@query("messages", " SELECT id, sha256(trim(lower(content), ' ')) AS question_key, sha256('internal:[1, 3, 7]') AS scope_key FROM messages")
def cache_keys(t):
    return t.messages.select(
        "id", policy.question_key(F.col("content")).alias("question_key"),
        policy.scope_key(F.lit("internal"), F.array(F.lit(7), F.lit(1), F.lit(3))).alias("scope_key"),
    )


@query(None, "SELECT event_id, greatest(0.0, least(10.0, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0))) AS score FROM events")
def judge_parse(t):
    raw = F.concat(F.lit("Verdict: "), F.replace("props", F.lit('"k"'), F.lit('"score"')), F.lit(" done"))
    return t.events.select("event_id", policy.judge_score(raw).alias("score"))


@query(
    None,
    """SELECT event_id, CASE WHEN v IS NULL OR NOT regexp_matches(v, '^\\s*[+-]?\\d+\\s*$') THEN 'type' WHEN v NOT IN ('1', '2', '5', '40', '77')
  AND event_type = 'view' THEN 'allowed'
  WHEN v::DOUBLE < 3 THEN 'min' WHEN v::DOUBLE > 60 THEN 'max' END AS error FROM (SELECT event_id, event_type, json_extract_string(props,
  '$.k') AS v FROM events)""",
)
def config_cast_validate(t):
    v = F.get_json_object("props", "$.k")
    allowed = F.when(F.col("event_type") == "view", F.array(*[F.lit(x) for x in ("1", "2", "5", "40", "77")]))
    return t.events.select("event_id", policy.config_error(v, F.lit("int"), F.lit(3.0), F.lit(60.0), allowed).alias("error"))


@query("messages", """ SELECT id, CASE WHEN content IS NULL OR trim(content) = '' THEN 'empty' WHEN length(content) < 165 THEN 'too_short' WHEN length(content) >
  1100 THEN 'too_long' END AS error FROM messages""")
def chunk_validation(t):
    return t.messages.select("id", policy.chunk_error(F.col("content"), 550).alias("error"))


# ---- chunks


_ISLANDS = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM
  documents),
f AS (SELECT *, regexp_matches(line, '^\|.+\|\s*$') AS tab FROM l), c AS (SELECT *, coalesce((tab <> lag(tab) OVER w)::INT, 0) AS change
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c),
g AS (SELECT doc_id, island, CASE WHEN any_value(tab) THEN 'table' ELSE 'text' END AS kind, regexp_replace(string_agg(line, chr(10) ORDER BY
  pos), '^\s+|\s+$', '', 'g') AS content FROM i GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INTEGER AS segment, kind, content FROM g WHERE content <> ''"""


@query(None, _ISLANDS)
def table_text_islands(t):
    return chunking.islands(t.documents.select("doc_id", "text"), "doc_id")


@query(None, """SELECT doc_id, (start // 350)::INTEGER AS chunk_index, substr(text, start + 1, 550) AS chunk FROM (SELECT doc_id, text, unnest(range(0,
  length(text), 350)) AS start FROM documents)""")
def stride_chunks(t):
    return chunking.stride_chunks(t.documents.select("doc_id", "text"), 550, 200).select("doc_id", "chunk_index", "chunk")


@query()
def recursive_chunks(t):
    return chunking.recursive_chunks(t.documents.select("doc_id", "text")).select("doc_id", "chunk_index", "chunk")


@query()
def legal_chunks(t):
    return chunking.recursive_chunks(t.documents.select("doc_id", "text"), "legal").select("doc_id", "chunk_index", "chunk")


@query("messages", """ SELECT conv_id, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS content, min(turn) AS page_start, max(turn) AS page_end, list(turn
  ORDER BY turn) AS pages FROM messages GROUP BY conv_id""")
def merge_pages(t):
    return chunking.merge_pages(t.messages, "conv_id", "turn", "content")


@query(None, """SELECT source, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM (SELECT source, substr(text, start + 1, 550) AS chunk FROM
  (SELECT source, text, unnest(range(0, length(text), 350)) AS start FROM documents)) GROUP BY source""")
def chunk_stats(t):
    return (
        chunking.stride_chunks(t.documents.select("source", "text"), 550, 200)
        .groupBy("source")
        .agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))
    )


@query()
def markdown_sections(t):
    return chunking.sections(t.documents.select("doc_id", "text"), "doc_id")


# ---- ranking

_BM25 = f"""{_TOKENS}, q AS (SELECT qid, {_STEM} AS token, count(*) AS times FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text),
  '[a-zа-яё0-9]{{2,}}')) AS raw FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM tok WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT
  token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-zа-яё0-9]{{2,}}'))) AS avgdl FROM documents),
sc AS (SELECT qid, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6)
  AS score FROM p JOIN df USING (token) JOIN q USING (token), s GROUP BY ALL),
sparse AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM sc)"""
_OVERLAP = """, dq AS (SELECT DISTINCT qid, token FROM q), dsz AS (SELECT qid, count(*) AS size FROM dq GROUP BY qid), dsc AS (SELECT qid, doc_id,
  round(count(*) / any_value(size), 6) AS score FROM p JOIN dq USING (token) JOIN dsz USING (qid) GROUP BY ALL),
dense AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM dsc)"""
_FUSED = _BM25 + _OVERLAP + """, fused AS (SELECT qid, doc_id, round(sum(part), 6) AS score FROM (SELECT qid, doc_id, 1.5 / (30 + rank) AS part FROM dense WHERE rank <= 25
  UNION ALL SELECT qid, doc_id, 0.5 / (30 + rank) FROM sparse WHERE rank <= 25) GROUP BY ALL),
hyb AS (SELECT f.*, sha256(text)[:16] AS hash FROM fused f JOIN documents USING (doc_id)),
one AS (SELECT *, row_number() OVER (PARTITION BY qid, hash ORDER BY score DESC, doc_id) AS nth FROM hyb),
cand AS (SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM one WHERE nth = 1)"""


def _asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query(None, f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM sparse WHERE rank <= 10")
def bm25_batch(t):
    return t.index.search(_asked(t), 10)


@query(None, f"""WITH {_BM25.replace('FROM benchmark)', 'FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))')} SELECT qid, doc_id, score,
  rank FROM sparse WHERE rank <= 10""")
def bm25_topk(t):
    first = t.benchmark.agg(F.min("item_id").alias("qid"))
    return t.index.search(_asked(t).join(F.broadcast(first), "qid", "left_semi"), 10)


_COSINE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, c.vec_id,
  round(list_cosine_similarity(q.v, c.v), 6) AS score, q.label AS ql, c.label AS cl FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <>
  q.vec_id {0}),
r AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)"""


@query(None, _COSINE.format("") + " SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10")
def cosine_topk(t):
    return vector.cosine_top_k(t.embeddings.filter(F.col("vec_id") % 20 == 0), t.embeddings, 10)


@query(None, _COSINE.format("AND c.label IN (1, 2, 3)") + " SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10")
def cosine_filtered(t):
    return vector.cosine_top_k(t.embeddings.filter(F.col("vec_id") % 20 == 0), t.embeddings.filter(F.col("label").isin(1, 2, 3)), 10)


# the rate is one of all vectors, so here every row is a query
@query(None, _COSINE.format("").replace("q.vec_id % 20 = 0 AND ", "") + " SELECT round(avg(hit), 4) AS hit_rate, round(avg(mrr), 4) AS mrr FROM (SELECT qid, max((ql = cl)::INT) AS hit, coalesce(1.0 / min(rank) FILTER (WHERE ql = cl), 0.0) AS mrr FROM r WHERE rank <= 10 GROUP BY qid)")
def label_hit_rate(t):
    found = vector.cosine_top_k(t.embeddings, t.embeddings, 10)
    labels = t.embeddings.select("vec_id", "label")
    both = (
        found.join(labels.select("vec_id", F.col("label").alias("cl")), "vec_id")
        .join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid")
    )
    same = F.col("cl") == F.col("ql")  # null where a label is; a query with nulls alone has no hit rate
    first = F.min(F.when(same, F.col("rank")))
    per = both.groupBy("qid").agg(F.max(same.cast("int")).alias("hit"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"))
    return per.agg(F.round(F.avg("hit"), 4).alias("hit_rate"), F.round(F.avg("mrr"), 4).alias("mrr"))


@query(None, f"""WITH {_BM25}{_OVERLAP} SELECT qid, doc_id, round(sum(part), 6) AS score FROM (SELECT qid, doc_id, 1.0 / (60 + rank) AS part FROM dense WHERE
  rank <= 25 UNION ALL SELECT qid, doc_id, 1.0 / (60 + rank) FROM sparse WHERE rank <= 25) GROUP BY ALL""")
def rrf_fusion(t):
    return answer.fused_lists(t.index, _asked(t), 25, (1.0, 1.0), rank.RRF_K)


@query(None, f"WITH {_FUSED} SELECT qid, doc_id, score FROM fused")
def weighted_rrf(t):
    return answer.fused_lists(t.index, _asked(t), 25, (1.5, 0.5), 30)


@query(None, f"WITH {_FUSED} SELECT qid, doc_id, score, rank FROM cand")
def hybrid_candidates(t):
    return answer.hybrid(t.index, _asked(t))


@query(None, f"""WITH {_BM25} SELECT qid, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM sparse WHERE rank <= 10 AND
  score >= 5) WHERE best <= 0 OR score >= best * 0.6""")
def rerank_filters(t):
    return rank.threshold(t.index.search(_asked(t), 10), "qid", 5.0, 0.6)


@query(None, f"""WITH {_BM25} SELECT qid, doc_id, score FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM sparse WHERE rank <= 25) WHERE score
  >= best * 0.9""")
def gap_filter(t):
    return rank.threshold(t.index.search(_asked(t), 25), "qid", 0.0, 0.9).select("qid", "doc_id", "score")


@query(None, f"""WITH {_FUSED}, r AS (SELECT qid, source, list(DISTINCT doc_id ORDER BY doc_id) AS pages, round(max(score), 6) AS max_score, count(*) AS n
  FROM cand JOIN documents USING (doc_id) GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY max_score DESC,
  source))::INTEGER AS rank FROM r""")
def source_rollup(t):
    rows = answer.hybrid(t.index, _asked(t)).join(t.documents.select("doc_id", "source"), "doc_id")
    return rank.by_source(rows.withColumnRenamed("doc_id", "page").drop("rank"), "qid", digits=6)


@query("messages", r""" , s AS (SELECT *, list_transform(list_distinct(regexp_extract_all(content, '\[(\d{1,9})\]', 1)), lambda x: x::INT) AS named FROM messages)
SELECT id, CASE WHEN len(list_intersect(named, [1, 2, 3])) = 0 THEN ['a', 'b', 'c'] ELSE list_filter(['a', 'b', 'c'], lambda x, i:
  list_contains(named, i)) END AS sources FROM s""")
def citation_filter(t):
    return t.messages.select("id", rank.cited(F.col("content"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("sources"))


@query(
    None,
    f"""WITH {_FUSED}, part AS (SELECT c.*, '[' || rank || '] ' || source || chr(10) || text AS part FROM cand c JOIN documents USING (doc_id)),
run AS (SELECT *, coalesce(sum(length(part) + 6) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM part),
cut AS (SELECT *, max((rank > 1 AND spent + length(part) > 12000)::INT) OVER (PARTITION BY qid ORDER BY rank) AS over FROM run)
SELECT qid, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_parts FROM cut WHERE over = 0 GROUP BY qid""",
)
def context_budget(t):
    null = F.lit(None).cast("string")
    rows = answer.hybrid(t.index, _asked(t)).join(t.documents.select("doc_id", "text", "source"), "doc_id")
    rows = rows.withColumn("part", F.concat(context.header(F.col("rank"), F.col("source"), null, null, null, null, null, null), F.lit("\n"), F.col("text")))
    return context.joined(context.within_budget(rows, "qid", F.length("part"), 3000 * context.CHARS_PER_TOKEN), "qid", "part")


@query(None, f"WITH {_FUSED} SELECT qid, least(1.0, greatest(0.0, round(avg(score), 6))) AS confidence FROM cand GROUP BY qid")
def answer_confidence(t):
    return rank.confidence(answer.hybrid(t.index, _asked(t)), "qid").withColumn("confidence", F.round("confidence", 6))


@query()
def answer_context(t):
    docs = t.docs.filter(acl.visible("internal", 2, [1, 2], for_list=False))
    return answer.answer_context(t.index, docs, _asked(t))


@query()
def rerank_lexical(t):
    found = answer.hybrid(t.index, _asked(t)).join(t.documents.select("doc_id", "text"), "doc_id").join(_asked(t), "qid")
    return (
        rank.rerank(found, "qid", F.round(vector.lexical_rerank(F.col("question"), F.col("text")), 6), 4, F.col("doc_id"))
        .select("qid", "doc_id", "score", "rank")
    )


# ---- evaluation

_EVAL = f"WITH {_FUSED}, h AS (SELECT item_id AS qid, arg_min(d.source, d.doc_id) AS source_hint FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"


@query(
    None,
    _EVAL + """, k AS (SELECT c.*, source FROM cand c JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT h.qid, CASE WHEN any_value(source_hint) IS NOT NULL THEN coalesce(max(contains(lower(source), lower(source_hint))::INT), 0) END::INTEGER AS hit_rate,
  CASE WHEN any_value(source_hint) IS NOT NULL THEN round(coalesce(1.0 / min(rank) FILTER (WHERE contains(lower(source), lower(source_hint))),
  0.0), 4) END AS mrr, round(avg(score), 4) AS avg_similarity
FROM h LEFT JOIN k ON h.qid = k.qid GROUP BY h.qid""",
)
def hit_rate_mrr(t):
    found = answer.hybrid(t.index, _asked(t)).filter("rank <= 10").join(t.documents.select("doc_id", "source"), "doc_id")
    return evaluation.retrieval_metrics(found, t.questions)


_SPACE = {"fetch_k": {"values": [10, 25]}, "top_k": {"values": [1, 4, 10]}, "rrf_k": {"min": 30, "max": 60, "step": 30}, "dense_weight": {"values": [0.5, 1.5]}, "sparse_weight": {"values": [1.0]}}
_SWEEP = _EVAL + """, g AS (SELECT (((a.i * 3 + b.i) * 2 + c.i) * 2 + d.i)::INTEGER AS config_id, a.v AS fetch_k, b.v AS top_k, c.v AS rrf_k, d.v AS dw
  FROM (VALUES (0, 10), (1, 25)) a(i, v), (VALUES (0, 1), (1, 4), (2, 10)) b(i, v), (VALUES (0, 30), (1, 60)) c(i, v), (VALUES (0, 0.5), (1, 1.5)) d(i, v)),
u AS (SELECT config_id, top_k, qid, doc_id, round(sum(part), 9) AS score FROM (SELECT config_id, top_k, qid, doc_id, dw::DOUBLE / (rrf_k +
  rank) AS part FROM dense, g WHERE rank <= fetch_k
  UNION ALL SELECT config_id, top_k, qid, doc_id, 1.0::DOUBLE / (rrf_k + rank) FROM sparse, g WHERE rank <= fetch_k) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY config_id, qid ORDER BY score DESC, doc_id) AS rank FROM u), hh AS (SELECT * FROM h WHERE
  source_hint IS NOT NULL),
f AS (SELECT config_id, qid, min(rank) AS first FROM t JOIN documents USING (doc_id) JOIN hh USING (qid) WHERE rank <= top_k AND
  contains(lower(source), lower(source_hint)) GROUP BY ALL),
m AS (SELECT g.config_id, round(avg((first IS NOT NULL)::INT), 3) AS hit_rate, round(avg(coalesce(1.0 / first, 0.0)), 4) AS mrr FROM g CROSS
  JOIN hh LEFT JOIN f ON f.config_id = g.config_id AND f.qid = hh.qid GROUP BY g.config_id)"""


def _swept(t: Tables) -> DataFrame:
    places = t.index.lists(_asked(t), 25).withColumnRenamed("doc_id", "key")
    return evaluation.sweep(
        places, ["dense", "sparse"], evaluation.grid(t.spark, _SPACE), t.questions,
        t.documents.select(F.col("doc_id").alias("key"), "source"),
    )


@query(None, _SWEEP + " SELECT * FROM m")
def grid_sweep(t):
    return _swept(t)


@query(None, _SWEEP + " SELECT config_id, round((0.6 * hit_rate + 0.4 * mrr) / (0.6 + 0.4), 4) AS composite FROM m")
def composite_rank(t):
    return (
        _swept(t).withColumn("faithfulness", F.lit(None).cast("double"))
        .select("config_id", evaluation.composite({"hit_rate": 0.6, "mrr": 0.4, "faithfulness": 0.5, "relevancy": 0.0}).alias("composite"))
    )


_RUNS = " , runs AS (SELECT date_trunc('day', started_at) AS day, question AS dataset, avg(latency) AS mrr, max(latency) AS faithfulness, min(latency) AS relevancy, count(*) AS n FROM logs GROUP BY ALL)"


def _runs(t: Tables) -> DataFrame:
    return (
        t.logs.groupBy(F.date_trunc("day", "started_at").alias("day"), F.col("question").alias("dataset"))
        .agg(
            F.avg("latency").alias("mrr"), F.max("latency").alias("faithfulness"), F.min("latency").alias("relevancy"),
            F.count("*").alias("n"),
        )
    )


@query("logs", _RUNS + """ SELECT dataset, count(*) AS n, round(avg(mrr), 3) AS mrr, round(avg(faithfulness), 1) AS faithfulness, round(avg(relevancy), 1) AS relevancy
  FROM runs GROUP BY dataset""")
def summary_metrics(t):
    return evaluation.summary(_runs(t), ["dataset"], {"mrr": 3, "faithfulness": 1, "relevancy": 1})


@query("logs", _RUNS + """ SELECT round(avg(m), 4) AS mrr, max(r) AS runs FROM (SELECT dataset, avg(mrr) AS m, count(DISTINCT day) AS r FROM runs GROUP BY dataset)""")
def multi_run_average(t):
    return evaluation.over_runs(_runs(t), "dataset", "day", ["mrr"])


@query(
    "logs",
    _RUNS + """, v AS (SELECT dataset AS metric, avg(mrr) FILTER (WHERE day >= TIMESTAMP '2024-01-16') AS c, avg(mrr) FILTER (WHERE day < TIMESTAMP
  '2024-01-16') AS b FROM runs GROUP BY dataset),
t AS (SELECT * FROM (VALUES ('click', -0.05::DOUBLE), ('view', -1.0::DOUBLE), ('purchase', 100.0::DOUBLE), ('absent', -1.0::DOUBLE)) t(metric, threshold))
SELECT metric, round(b, 4) AS baseline, round(c, 4) AS current, round(c - b, 4) AS delta, threshold, coalesce(c - b < threshold, false) AS
  failed FROM t LEFT JOIN v USING (metric)""",
)
def regression_check(t):
    side = lambda late: _runs(t).filter((F.col("day") >= F.lit("2024-01-16").cast("timestamp")) == late).groupBy(F.col("dataset").alias("metric")).agg(F.avg("mrr").alias("value"))
    return evaluation.compare(side(True), side(False), t.spark, {"click": -0.05, "view": -1.0, "purchase": 100.0, "absent": -1.0})


@query("logs", _RUNS + " SELECT dataset AS key, max(n::VARCHAR) FILTER (WHERE day = TIMESTAMP '2024-01-02') AS \"2\", max(n::VARCHAR) FILTER (WHERE day = TIMESTAMP '2024-01-03') AS \"3\" FROM runs WHERE day IN (TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03') GROUP BY dataset")
def run_diff(t):
    days = _runs(t).withColumn("run", F.dayofmonth("day")).filter(F.col("run").isin(2, 3))
    configs = days.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("dataset", F.col("n").cast("string")))).alias("config"))
    return evaluation.side_by_side(configs, "run", [2, 3])


@query("logs", _RUNS + " SELECT dataset, day, round(mrr - lag(mrr) OVER (PARTITION BY dataset ORDER BY day), 9) AS delta FROM runs")
def trend_lag(t):
    return evaluation.trend(_runs(t), "dataset", "day", "mrr", digits=9).select("dataset", "day", "delta")


@query("logs", _RUNS + " SELECT dataset, day FROM runs WHERE faithfulness < 5 OR relevancy < 5")
def problem_runs(t):
    return evaluation.problems(_runs(t)).select("dataset", "day")


@query("logs", _RUNS + " SELECT dataset, arg_max(n, day) AS n, max(day) AS day FROM runs GROUP BY dataset")
def latest_run(t):
    return tables.latest(_runs(t).select("dataset", "day", "n"), ["dataset"], ["day"])


# ---- metrics

_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query("logs", " SELECT question, unnest([" + ", ".join(f"{b}::DOUBLE" for b in _BOUNDS) + ", 'inf'::DOUBLE]) AS le, unnest([" + ", ".join(f"count_if(latency <= {b})::BIGINT" for b in _BOUNDS) + ", count(latency)]) AS n FROM logs GROUP BY question")
def latency_histogram(t):
    return tables.histogram(t.logs, ["question"], "latency", _BOUNDS)


@query("logs", """ SELECT user_id, count(*) AS n, round(sum(latency) / count(*), 4) AS mean FROM logs GROUP BY user_id ORDER BY n DESC, user_id LIMIT 6""")
def endpoint_topk(t):
    sums = t.logs.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("latency") / F.count("*"), 4).alias("mean"))
    return tables.page(sums, [F.desc("n"), F.col("user_id")], 6)


@query("logs", """ SELECT question, status, count(*) AS n, round(avg(latency), 4) AS mean, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM
  logs GROUP BY ALL""")
def metric_rollup(t):
    sums = t.logs.groupBy("question", "status").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 4).alias("mean"))
    return sums.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("logs", " SELECT CASE WHEN bool_or(starts_with(question, 'error')) THEN 'degraded' ELSE 'ok' END AS overall FROM logs")
def health_rollup(t):
    return tables.health(t.logs, "question")


# ---- streams, as batches over the same functions


@query(None, "SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY ALL")
def rate_limit_windows(t):
    return streams.rate_windows(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 1)


@query(
    None,
    """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM
  events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS
  "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_windows(t):
    return streams.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours")


@query(None, "SELECT event_type, date_trunc('day', ts) AS day FROM events GROUP BY ALL")
def dedup_watermark(t):
    """A stream of the events, each a key of type and day; what the stream wrote is read back."""
    events = t.spark.readStream.schema(t.events.schema).parquet(t.dir, pathGlobFilter="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    keyed = events.withColumn("day", F.date_trunc("day", "ts")).withColumn("key", F.concat_ws("/", "event_type", "day"))
    out = new_path(t.spark, "dedup")
    streams.run_once(streams.first_seen(keyed, "key", "ts", "2 days").select("event_type", "day"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema("event_type string, day timestamp").parquet(f"{out}/rows")


@query(None, """SELECT event_type, time_bucket(INTERVAL 30 SECOND, ts) AS start, count(*) AS n, arg_max(value, (ts, value)) AS last, round(avg(value), 9) AS
  mean FROM events GROUP BY ALL""")
def gauge_windows(t):
    return streams.gauges(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "value", "ts").withColumn("mean", F.round("mean", 9))


@query("logs", " SELECT id FROM logs WHERE started_at + INTERVAL 7 DAY > TIMESTAMP '2024-01-30'")
def ttl_expiry(t):
    return streams.alive(t.logs, F.lit("2024-01-30").cast("timestamp"), "started_at", 7 * 86_400).select("id")


@query(None, f"""WITH {_TOKENS} SELECT token, count(DISTINCT doc_id) AS df FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP
  BY token""")
def incremental_index(t):
    """A live index of all documents from which those labelled as bad are removed by a second batch."""
    index = streams.LiveIndex(t.spark, new_path(t.spark, "live"))
    docs = t.documents.select("doc_id", "text", F.lit(False).alias("deleted"), F.lit(0).alias("seq"))
    bad = t.labels.filter("quality = 0").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"), F.lit(1).alias("seq"))
    index.apply(docs)
    index.apply(bad)
    return index.stats()


@query("logs", " SELECT user_id AS key, arg_max(question, (started_at, question)) AS value, max(started_at) AS ts FROM logs GROUP BY user_id")
def config_latest(t):
    return streams.current_config(t.logs.select(F.col("user_id").alias("key"), F.col("question").alias("value"), F.col("started_at").alias("ts")))


# ---- further reads


@query(None, """SELECT count(*) AS files, sum(n)::BIGINT AS documents, sum(chars)::BIGINT AS chars FROM (SELECT source, count(*) AS n, sum(length(text)) AS
  chars FROM documents GROUP BY source)""")
def registry_totals(t):
    sums = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return sums.agg(F.count("*").alias("files"), F.sum("n").alias("documents"), F.sum("chars").alias("chars"))


@query(None, f"WITH {_FUSED} SELECT qid, max(score) AS best FROM cand GROUP BY qid")
def best_source_score(t):
    listed = answer.hybrid(t.index, _asked(t)).groupBy("qid").agg(F.collect_list(F.struct("doc_id", "score")).alias("sources"))
    return listed.select("qid", F.array_max(F.transform("sources", lambda x: x["score"])).alias("best"))


@query(None, """SELECT source, round(100.0 * count(vec_id) / count(*), 6) AS percent FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source""")
def index_coverage(t):
    both = t.documents.select("doc_id", "source").join(t.embeddings.select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return both.groupBy("source").agg(F.round(100.0 * F.count("vec_id") / F.nullif(F.count("*"), F.lit(0)), 6).alias("percent"))


@query("logs", """ SELECT CASE WHEN latency / 100 >= 0.7 THEN 'good' WHEN latency / 100 >= 0.4 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM logs
  GROUP BY 1""")
def score_bands(t):
    return t.logs.groupBy(policy.score_band(F.col("latency") / 100).alias("band")).agg(F.count("*").alias("n"))


@query("logs", """ SELECT question, ceil(0.5 * count(*))::BIGINT AS quick_minutes, ceil(0.5 * count(*))::BIGINT + 6 AS judged_minutes FROM logs GROUP BY
  question""")
def time_estimate(t):
    quick = F.ceil(F.lit(0.5) * F.count("*"))
    return t.logs.groupBy("question").agg(quick.alias("quick_minutes"), (quick + 2 * 3).alias("judged_minutes"))


@query("logs", " SELECT id, round(latency * 1000, 1) AS ms, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS at FROM logs")
def latency_ms(t):
    return t.logs.select("id", F.round(F.col("latency") * 1000, 1).alias("ms"), F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query(None, """SELECT doc_id, list(sha256(chunk)[:16] ORDER BY i) AS hashes FROM (SELECT doc_id, start // 350 AS i, substr(text, start + 1, 550) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 350)) AS start FROM documents)) GROUP BY doc_id""")
def nested_chunks(t):
    chunks = (
        chunking.stride_chunks(t.documents.select("doc_id", "text"), 550, 200)
        .select("doc_id", F.struct("chunk_index", text.content_hash(F.col("chunk")).alias("hash")).alias("c"))
    )
    return chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["hash"]).alias("hashes"))


@query("messages", """ SELECT d.doc_id, CASE WHEN length(m.content) > 1.5 * length(d.text) THEN m.content ELSE d.text END AS text FROM documents d LEFT JOIN
  messages m ON m.id = d.doc_id""")
def ocr_override(t):
    seen = t.documents.select("doc_id", "text").join(t.messages.select(F.col("id").alias("doc_id"), "content"), "doc_id", "left")
    return seen.select("doc_id", text.better_text(F.col("text"), F.col("content")).alias("text"))


@query(None, "SELECT user_id, list(event_id ORDER BY round(value / 10) * 10, event_id) AS blocks FROM events GROUP BY user_id")
def block_order(t):
    blocks = F.array_sort(F.collect_list(F.struct((F.round(F.col("value") / 10) * 10).alias("y"), "event_id")))
    return t.events.groupBy("user_id").agg(F.transform(blocks, lambda b: b["event_id"]).alias("blocks"))


@query(None, "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(t):
    return t.customer.filter(F.col("c_custkey") == 7).select("c_custkey", "c_name")


@query("users", " SELECT count(*) > 0 AS has_admin FROM (SELECT 1 FROM users WHERE role = 'admin' LIMIT 1)")
def exists_admin(t):
    return t.users.filter(F.col("role") == "admin").limit(1).agg((F.count("*") > 0).alias("has_admin"))


@query("docs", """ SELECT doc_id, source FROM docs WHERE source = 'src3' AND owner_id IS NULL AND group_id IS NOT DISTINCT FROM 3 ORDER BY doc_id DESC LIMIT 1""")
def active_slot(t):
    slot = (F.col("source") == "src3") & F.col("owner_id").eqNullSafe(F.lit(None)) & F.col("group_id").eqNullSafe(F.lit(3))
    return tables.page(t.docs.filter(slot), [F.desc("doc_id")], 1).select("doc_id", "source")


@query("docs", " SELECT doc_id, visibility IN ('internal_private', 'client_private') AND owner_id IS NOT DISTINCT FROM 7 AS can_edit FROM docs")
def edit_rights(t):
    return t.docs.select("doc_id", acl.can_edit(F.col("visibility"), F.col("owner_id"), F.lit(7), F.lit("user")).alias("can_edit"))


@query("docs", " SELECT owner_id, source, count(*) AS n FROM docs WHERE visibility <> 'internal_group' GROUP BY ALL HAVING count(*) > 1")
def active_name_conflicts(t):
    return tables.duplicates(t.docs.filter(F.col("visibility") != acl.GROUP), ["owner_id", "source"])


@query("docs users memberships", """ SELECT doc_id FROM docs WHERE visibility = 'internal_group' AND group_id IN (SELECT group_id FROM memberships JOIN users USING (user_id)
  WHERE kind = 'client')""")
def group_documents(t):
    mine = t.memberships.join(t.users.filter(F.col("kind") == "client"), "user_id")
    return t.docs.filter(F.col("visibility") == acl.GROUP).join(mine, "group_id", "left_semi").select("doc_id")


@query(None, "SELECT DISTINCT source FROM documents WHERE source IN (SELECT 'src' || l_linenumber FROM lineitem)")
def upload_conflicts(t):
    new = t.lineitem.select(F.concat(F.lit("src"), F.col("l_linenumber").cast("string")).alias("source"))
    return t.documents.select("source").distinct().join(new, "source", "left_semi")


@query(
    None,
    """SELECT user_id, list_sort(list_intersect(k, ['click', 'error', 'other'])) AS expensive, list_sort(list_filter(['click', 'view', 'other'],
  lambda x: NOT list_contains(k, x))) AS missing, list_sort(k) AS keys
FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY user_id)""",
)
def config_keys(t):
    known = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    want = lambda *v: F.array(*map(F.lit, v))
    return known.select(
        "user_id", F.array_sort(F.array_intersect("k", want("click", "error", "other"))).alias("expensive"),
        F.array_sort(F.array_except(want("click", "view", "other"), F.col("k"))).alias("missing"), F.array_sort("k").alias("keys"),
    )


@query(
    None,
    """WITH p(param, key) AS (VALUES ('view', 'retrieval.view'), ('click', 'retrieval.click'), ('error', 'retrieval.error'))
SELECT key, event_type AS param, max(value)::VARCHAR IS NOT NULL AS applied, key IS NULL AS failed FROM (SELECT DISTINCT event_type, 1 AS
  value FROM events) e LEFT JOIN p ON event_type = param GROUP BY ALL""",
)
def apply_run_config(t):
    names = t.spark.createDataFrame([(x, f"retrieval.{x}") for x in ("view", "click", "error")], "param string, key string")
    config = t.events.select("event_type").distinct().agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.lit("1")))).alias("config"))
    each = config.select(F.explode("config").alias("param", "value")).join(F.broadcast(names), "param", "left")  # three names
    return each.select("key", "param", F.col("value").isNotNull().alias("applied"), F.col("key").isNull().alias("failed"))


@query("logs", """ SELECT user_id, arg_max(status, (started_at, id)) AS status, min(started_at) FILTER (WHERE status = 'running') AS first_run, count_if(status
  = 'failed')::BIGINT AS failures FROM logs GROUP BY user_id""")
def job_transitions(t):
    last = F.max_by("status", F.struct("started_at", "id"))
    return (
        t.logs.groupBy("user_id")
        .agg(
            last.alias("status"), F.min(F.when(F.col("status") == "running", F.col("started_at"))).alias("first_run"),
            F.count_if(F.col("status") == "failed").alias("failures"),
        )
    )


@query("messages", " SELECT DISTINCT conv_id FROM messages WHERE contains(lower(content), 'the ') OR contains(lower(content), 'de ')")
def conversation_search(t):
    return t.messages.filter(tables.contains_text(F.col("content"), "the ") | tables.contains_text(F.col("content"), "de ")).select("conv_id").distinct()


@query(None, """SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, len(list_filter(string_split(text, chr(10)), lambda l:
  regexp_matches(l, '\t[^\t]*\t|    ')))::INTEGER AS tabular FROM documents""")
def tabular_lines(t):
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), text.tabular_lines(F.col("text")).alias("tabular"))
