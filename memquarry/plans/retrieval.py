"""Queries of ranking and retrieval, over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memquarry.functions import vectors as V
from memquarry.operators import bank, retrieval as R
from memquarry.operators.keyword_index import postings
from memquarry.operators.vector_index import CellIndex
from memquarry.plans.registry import query

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(table: str, key: str, text: str, terms: list[str], keep: str = "TRUE", name: str = "kw") -> str:
    counts = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS t{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"CAST(count(*) FILTER (t{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    where = " AND ".join(f"t{i} > 0" for i in range(len(terms)))
    return (
        f"{name}_w AS (SELECT {key}, {keep} AS keep, {TOK.format(c=text)} AS w FROM {table}), {name}_c AS (SELECT {key}, keep, CAST(len(w) AS DOUBLE) AS dl, {counts} FROM {name}_w), "
        f"{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {dfs} FROM {name}_c), {name} AS (SELECT {key}, round({score}, 6) AS score FROM {name}_c, {name}_s WHERE keep AND {where})"
    )


def cosine_sql(name: str = "vec", one: int = 0) -> str:
    return f"{name} AS (SELECT e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {one}) q)"


def rrf_sql(k: int, kw: str = "kw", vec: str = "vec") -> str:
    top = lambda n: f"{n}_t AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {n} ORDER BY score DESC, doc_id LIMIT {3 * k})"
    return (
        f"{top(kw)}, {top(vec)}, both_legs AS (SELECT doc_id, 0.3 / (60 + rank) AS s, 'keyword' AS leg FROM {kw}_t UNION ALL SELECT doc_id, 0.7 / (60 + rank), 'vector' FROM {vec}_t), "
        f"fused AS (SELECT doc_id, round(sum(CAST(s AS DOUBLE)), 8) AS score, string_agg(leg, '+' ORDER BY leg) AS origin FROM both_legs GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k})"
    )


QUERY, TERMS = "The, WITH", ["the", "with"]


def _vector(t, one=0):
    return t("embeddings").where(F.col("vec_id") == one)


@query("WITH " + bm25_sql("documents", "doc_id", "text", TERMS) + " SELECT doc_id, score FROM kw ORDER BY score DESC, doc_id LIMIT 50")
def bm25_chunks(t):
    return R.top(R.bm25(t("documents"), QUERY), 50)


@query("WITH " + bm25_sql("documents", "doc_id", "text", TERMS) + " SELECT doc_id, score FROM kw")
def bm25_all_matches(t):
    return R.bm25(t("documents"), QUERY)


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + TOK.format(c="text") + ") AS term FROM documents) GROUP BY 1, 2")
def postings_index(t):
    return postings(t("documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query("WITH " + cosine_sql() + " SELECT doc_id AS vec_id, score FROM vec ORDER BY score DESC, doc_id LIMIT 10")
def vector_topk(t):
    return R.vector_top_k(t("embeddings"), _vector(t), 10)


@query("WITH " + cosine_sql(one=3) + " SELECT doc_id, score, d.lang, d.source FROM (SELECT * FROM vec ORDER BY score DESC, doc_id LIMIT 30) JOIN documents d USING (doc_id)")
def vector_resolve(t):
    return R.resolved(R.vector_top_k(t("embeddings"), _vector(t, 3), 30), t("documents"), "vec_id").select("doc_id", "score", "lang", "source")


@query("WITH " + bm25_sql("documents", "doc_id", "text", TERMS) + ", " + cosine_sql() + ", " + rrf_sql(20) + " SELECT doc_id, score, origin, d.lang, d.n_chars FROM fused JOIN documents d USING (doc_id)")
def hybrid_rrf(t):
    return R.hybrid(t("documents"), t("embeddings"), QUERY, _vector(t), 20).select("doc_id", "score", "origin", "lang", "n_chars")


@query("WITH " + cosine_sql() + " SELECT doc_id, score, 'vector' AS origin FROM vec ORDER BY score DESC, doc_id LIMIT 15")
def hybrid_fallback(t):
    words = R.ranked(R.bm25(t("documents"), "zqxjkv notaword"), 45, "doc_id")
    vector = R.ranked(R.vector_scores(t("embeddings"), _vector(t)).withColumnRenamed("vec_id", "doc_id"), 45, "doc_id")
    return R.fuse(words, vector, 15)


_BANK = "bank AS (SELECT o_orderkey AS id, o_orderpriority AS title, 'status ' || o_orderstatus || ' clerk ' || (o_custkey % 50) AS content, 'tag' || (o_orderkey % 3) AS tag, CASE WHEN o_orderkey % 4 = 0 THEN 'superseded' ELSE 'active' END AS status FROM orders)"


def bank_rows(t):
    key = F.col("o_orderkey")
    return t("orders").select(
        key.alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("status "), "o_orderstatus", F.lit(" clerk "), (F.col("o_custkey") % 50).cast("string")).alias("content"),
        F.array(F.concat(F.lit("tag"), (key % 3).cast("string"))).alias("tags"), F.when(key % 4 == 0, "superseded").otherwise("active").alias("status"),
    )


@query("WITH " + _BANK + ", texts AS (SELECT *, title || ' ' || content || ' ' || tag AS body FROM bank), " + bm25_sql("texts", "id", "body", ["clerk", "tag1", "urgent"], "status = 'active'") + " SELECT id, score FROM kw ORDER BY score DESC, id LIMIT 40")
def bm25_bank(t):
    rows = bank_rows(t).withColumn("body", F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    return R.top(R.bm25(rows, "urgent clerk tag1", "id", "body", F.col("status") == "active"), 40, "id")


@query("WITH " + bm25_sql("part", "p_partkey", "p_name || ' ' || p_brand || ' ' || p_type", ["brand"], name="kw") + " SELECT p_partkey AS id, score FROM kw ORDER BY score DESC, p_partkey LIMIT 10")
def bm25_skills(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("body"))
    return R.top(R.bm25(rows, "brand", "id", "body"), 10, "id")


@query("WITH " + _BANK + ", texts AS (SELECT *, title || ' ' || content || ' ' || tag AS body FROM bank), " + bm25_sql("documents", "doc_id", "text", ["the"], name="a") + ", " + bm25_sql("texts", "id", "body", ["clerk"], "status = 'active'", "b") + " SELECT id, score, origin FROM (SELECT doc_id AS id, score, 'chunk' AS origin FROM a UNION ALL SELECT id, score, 'reasoning' FROM b) ORDER BY score DESC, origin, id LIMIT 60")
def keyword_search_all(t):
    rows = bank_rows(t).withColumn("body", F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    chunks = R.bm25(t("documents"), "the").withColumnRenamed("doc_id", "id")
    return R.search_all(chunks, R.bm25(rows, "clerk", "id", "body", F.col("status") == "active"), 60)


_HITS = "msg AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content, round(1.0 / (1 + length(text)), 6) AS score FROM conversations)"


def messages(t):
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), F.round(1.0 / (1 + F.length("text")), 6).alias("score"))


@query("WITH " + _HITS + ", best AS (SELECT * FROM msg ORDER BY score DESC, id LIMIT 100), own AS (SELECT *, row_number() OVER (PARTITION BY substr(lower(trim(content)), 1, 200) ORDER BY score DESC, id) AS r FROM best WHERE session_id = '' OR contains(session_id, '1')) SELECT id, session_id, role, score FROM own WHERE r = 1 ORDER BY score DESC, id LIMIT 50")
def recall_dedup(t):
    return R.recall(messages(t), 50, "1").select("id", "session_id", "role", "score")


@query("WITH " + _HITS + ", best AS (SELECT * FROM msg ORDER BY score DESC, id LIMIT 200), own AS (SELECT *, row_number() OVER (PARTITION BY substr(lower(trim(content)), 1, 200) ORDER BY score DESC, id) AS r FROM best WHERE score >= 0.005 AND role IN ('user', 'assistant')) SELECT id, role, score FROM own WHERE r = 1 ORDER BY score DESC, id LIMIT 20")
def augment_filter(t):
    return R.augment(messages(t), 20, ["user", "assistant"]).select("id", "role", "score")


@query("WITH " + _HITS + ", best AS (SELECT * FROM msg ORDER BY score DESC, id LIMIT 50), own AS (SELECT *, row_number() OVER (PARTITION BY substr(lower(trim(content)), 1, 200) ORDER BY score DESC, id) AS r FROM best WHERE score >= 0.005 AND role IN ('user')), k AS (SELECT * FROM own WHERE r = 1 ORDER BY score DESC, id LIMIT 5) SELECT string_agg('<memory role=\"' || role || '\">' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</memory>', chr(10) ORDER BY score DESC, id) AS context FROM k")
def augment_text(t):
    return R.augment_text(R.augment(messages(t), 5, ["user"]))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS chunks FROM conversations GROUP BY 1")
def session_list(t):
    return t("conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def role_counts(t):
    return t("conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def role_filter(t):
    return t("conversations").where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


@query("SELECT d.doc_id FROM documents d ANTI JOIN embeddings e ON d.doc_id = e.vec_id")
def backfill_missing(t):
    return R.not_in(t("documents").select("doc_id"), t("embeddings"), "doc_id", "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def vector_remove(t):
    gone = t("embeddings").where("label = 3").select("vec_id")
    return R.not_in(t("embeddings").select("vec_id", "label"), gone, "vec_id", "vec_id")


@query()
def vector_cells(t):
    """Every vector whose id is divisible by 20 against all vectors."""
    vectors = t("embeddings")
    return CellIndex(vectors).search(vectors.where("vec_id % 20 = 0"), 10)


_BITS = ", ".join(f"CAST(list_sum(list_transform(generate_series(1, 8), lambda i: CASE WHEN embedding[{g} * 8 + i] > 0 THEN CAST(pow(2, i - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) % 64 AS b{g}" for g in range(8))


@query(f"SELECT vec_id, {_BITS} FROM embeddings")
def semantic_buckets(t):
    index = R.bucket_index(t("embeddings"), 64)
    return index.select("vec_id", *[F.col("buckets")[g].alias(f"b{g}") for g in range(8)])


@query(f"WITH b AS (SELECT vec_id, {_BITS} FROM embeddings), m AS (SELECT x.vec_id, " + " + ".join(f"CASE WHEN x.b{g} = q.b{g} THEN 1 ELSE 0 END" for g in range(8)) + " AS shared FROM b x, (SELECT * FROM b WHERE vec_id = 0) q) SELECT vec_id, CAST(shared AS BIGINT) AS shared FROM m WHERE shared >= 1")
def semantic_bucket_search(t):
    return R.bucket_matches(R.bucket_index(t("embeddings"), 64), 0, least=1)


@query("SELECT label, count(*) AS n, round(avg(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS mean_square FROM embeddings GROUP BY label")
def vector_norms(t):
    v = F.col("embedding")
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.dot(v, v)), 6).alias("mean_square"))


# the bank is made of the documents' first lines; each near chunk's first five words ask for entries
_FIRST = "ent AS (SELECT doc_id AS id, substr(string_split(text, chr(10))[1], 1, 200) AS body FROM documents), near AS (SELECT vec_id, score FROM (SELECT doc_id AS vec_id, score FROM vec) WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY score DESC, vec_id LIMIT 5), asked AS (SELECT DISTINCT n.vec_id, n.score, t.term FROM near n JOIN documents d ON d.doc_id = n.vec_id, unnest(regexp_extract_all(lower(array_to_string(regexp_split_to_array(trim(d.text), '\\s+')[1:5], ' ')), '[\\p{L}\\p{N}]+')) AS t(term)), toks AS (SELECT id, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS w FROM ent), lens AS (SELECT id, len(w) AS dl FROM toks), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM toks) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), sc AS (SELECT a.vec_id, a.score AS cosine, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM asked a JOIN tf ON tf.term = a.term JOIN df ON df.term = a.term JOIN lens USING (id), st GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(*) FROM asked b WHERE b.vec_id = a.vec_id)), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS r FROM sc)"


@query("WITH " + cosine_sql() + ", " + _FIRST + " SELECT vec_id AS chunk_id, cosine, id FROM best WHERE r <= 3 AND cosine >= 0.1 AND id % 4 <> 0")
def semantic_contradictions(t):
    docs = t("documents")
    first = F.substring(F.split("text", "\n")[0], 1, 200)
    entries = docs.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), first.alias("content"), F.array().cast("array<string>").alias("tags"), F.when(F.col("doc_id") % 4 == 0, "superseded").otherwise("active").alias("status"))
    held = t("embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "id")
    return bank.semantic_contradictions(entries, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), held, _vector(t), least=0.1)


_ISSUES = "CASE WHEN trim(coalesce(o_orderpriority, '')) = '' THEN 'empty title,' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'empty content,' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'no evidence,' ELSE '' END"


@query(f"SELECT o_orderkey AS id, rtrim({_ISSUES}, ',') AS issues FROM orders")
def guardian_issues(t):
    key = F.col("o_orderkey")
    content = F.when(key % 5 == 0, " ").otherwise(F.col("o_orderstatus"))
    evidence = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))
    return t("orders").select(key.alias("id"), F.array_join(bank.issues(F.col("o_orderpriority"), content, evidence), ",").alias("issues"))


@query("WITH " + _BANK + ", texts AS (SELECT *, title || ' ' || content || ' ' || tag AS body FROM bank), " + bm25_sql("texts", "id", "body", ["7", "urgent"], "status = 'active'") + ", k AS (SELECT * FROM kw ORDER BY score DESC, id LIMIT 5) SELECT id, score FROM k WHERE score > 5.0")
def guardian_contradictions(t):
    return bank.contradictions(bank_rows(t), "7 urgent")


@query("SELECT l_orderkey, l_linenumber, l_discount BETWEEN 0 AND 0.05 AND l_returnflag <> 'R' AS ok FROM lineitem")
def evidence_validation(t):
    sources = F.when(F.col("l_returnflag") == "R", F.array().cast("array<string>")).otherwise(F.array("l_returnflag"))
    return t("lineitem").select("l_orderkey", "l_linenumber", bank.evidence_ok(F.col("l_linestatus"), sources, F.round(F.col("l_discount") * 20, 9)).alias("ok"))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions")
def status_counts(t):
    one = lambda name, c: t(name).agg(c)
    return one("documents", F.count(F.lit(1)).alias("chunks")).crossJoin(one("embeddings", F.count(F.lit(1)).alias("vectors"))).crossJoin(one("conversations", F.count_distinct("conv_id").alias("sessions")))


@query("SELECT o_orderkey AS id, o_orderstatus AS outcome FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def audit_newest(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderdate").alias("created_at"))
    return bank.newest(rows, 100).select("id", "outcome")
