"""Queries of sequences, deduplication, texts and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memquarry.functions import text as T
from memquarry.operators import bank, dedup as D, sequence as S, slots
from memquarry.plans.registry import QUERIES, ORACLE_SQL, query
from memquarry.sources import sessions, store
from memquarry.streaming import trackers

# ---- sequences

_Z = "z AS (SELECT event_id, user_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)), zz AS (SELECT event_id, user_id, CASE WHEN n >= 5 THEN round((value - m) / CASE WHEN s < 1e-12 THEN 0.001 ELSE s END, 6) END AS z FROM z)"


@query("WITH " + _Z + " SELECT event_id, user_id, z, CASE WHEN z < -3 THEN 'high' WHEN z < -2 THEN 'medium' WHEN z > 4.5 THEN 'medium' WHEN z > 3 THEN 'low' END AS severity FROM zz")
def anomaly_zscore(t):
    return S.rolling_z(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "z", "severity")


@query("WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM l WHERE back <= 50), a AS (SELECT user_id, max(n) AS n, avg(value) AS m, stddev_pop(value) AS s, coalesce(avg(value) FILTER (back <= n - floor(n / 2)) - avg(value) FILTER (back > n - floor(n / 2)), 0) AS t FROM k GROUP BY user_id) SELECT user_id, n, round(m, 6) AS mean, round(s, 6) AS std, round(t, 6) AS trend, abs(t) > s AS drifting FROM a")
def drift_report(t):
    return S.drift(t("events"), "user_id", ["ts", "event_id"], "value")


_GRAMS = "o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM events), g AS (SELECT user_id, start, n, array_to_string(ahead[1:n], '>') AS motif FROM o, (SELECT unnest(generate_series(3, 10)) AS n) WHERE n <= len(ahead))"


@query("WITH " + _GRAMS + " SELECT user_id, motif, CAST(n AS INTEGER) AS n, count(*) AS occurrences, min(start) AS first_start, count(*) * n AS weight FROM g GROUP BY user_id, motif, n HAVING count(*) >= 2")
def motif_ngrams(t):
    return S.motifs(t("events"), "user_id", ["ts", "event_id"], "event_type")


@query("WITH " + _GRAMS + ", s AS (SELECT user_id, start + n - 1 AS place, n, row_number() OVER (PARTITION BY user_id, motif ORDER BY start) AS times FROM g) SELECT user_id, place, CAST(max(n) AS INTEGER) AS longest FROM s WHERE times >= 2 GROUP BY user_id, place")
def motif_running(t):
    return S.longest_known(t("events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS place, event_type AS event FROM events")
def motif_decode(t):
    return S.motif_decode(S.motif_encode(t("events"), "user_id", ["event_id"], "event_type"), "user_id")


@query()
def motif_encode(t):
    return S.motif_encode(t("events"), "user_id", ["event_id"], "event_type").drop("parts", "motifs")


_CHAIN = "WITH RECURSIVE p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations), c AS (SELECT conv_id, place, sha256(unhex(repeat('0', 64) || sha256(text))) AS link FROM p WHERE place = 0 UNION ALL SELECT p.conv_id, p.place, sha256(unhex(c.link || sha256(p.text))) FROM p JOIN c ON p.conv_id = c.conv_id AND p.place = c.place + 1)"


@query(_CHAIN + " SELECT conv_id, CAST(place AS INTEGER) AS place, link FROM c")
def hash_chain(t):
    return S.hash_chain(t("conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, NOT (turn = 1 AND conv_id % 2 = 0) AS ok FROM conversations")
def chain_verify(t):
    rows = t("conversations")
    changed = rows.withColumn("text", F.when((F.col("turn") == 1) & (F.col("conv_id") % 2 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return S.verify_chain(changed, S.hash_chain(rows, "conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS turn FROM events")
def fleet_interleave(t):
    return S.interleave(t("events").select("event_id", "event_type"), "event_type", "event_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn <= 2")
def timeline_snapshot(t):
    return S.snapshot(t("conversations").select("conv_id", "turn", "role"), "turn", 2)


@query("SELECT conv_id, turn, role FROM conversations WHERE turn > 1 AND turn <= 4")
def timeline_between(t):
    return S.between(t("conversations").select("conv_id", "turn", "role"), "turn", 4, 1)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_cos(t):
    return S.latest(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("WITH d AS (SELECT user_id, event_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events) SELECT user_id, event_id, delta, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS code FROM d")
def delta_code(t):
    return S.deltas(t("events").select("user_id", "event_id"), "user_id", ["event_id"], "event_id")


@query("SELECT user_id, event_id, event_id AS value FROM events")
def delta_decode(t):
    return S.undo_deltas(S.deltas(t("events").select("user_id", "event_id"), "user_id", ["event_id"], "event_id"), "user_id", ["event_id"]).select("user_id", "event_id", "value")


_LINKS = "l AS (SELECT o_custkey, o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS steps, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders)"


@query("WITH " + _LINKS + " SELECT id AS node, last, steps, false AS cyclic FROM l")
def supersession_chain(t):
    links = t("orders").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("nxt"))
    return bank.chains(links, "id", "nxt")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 1 THEN 'superseded' WHEN o_orderkey = 2 THEN 'retracted' ELSE 'active' END AS status, CASE WHEN o_orderkey = 1 THEN 'o5' ELSE '' END AS superseded_by FROM orders")
def bank_status(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("active").alias("status"), F.lit("").alias("superseded_by"))
    return bank.retracted(bank.superseded(rows, 1, "o5"), 2)


@query("SELECT p_brand AS name, max(p_size) AS version FROM part GROUP BY p_brand")
def skill_latest(t):
    rows = t("part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("version")).distinct()
    return bank.next_version(rows)


@query("SELECT c_custkey AS id, 'f1,' || 'f' || (c_custkey % 3) || ',new' AS facts, CASE WHEN c_custkey % 2 = 0 THEN 'q2,q3' ELSE 'q1,q2,q3' END AS questions FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, 'f1,new', CASE WHEN c_custkey % 2 = 0 THEN 'q2,q3' ELSE 'q1,q2,q3' END FROM customer WHERE c_custkey % 3 = 1")
def cos_merge(t):
    key = F.col("c_custkey")
    facts, questions = bank.merged_summary(
        F.array(F.lit("f1"), F.concat(F.lit("f"), (key % 3).cast("string"))), F.array(F.lit("new"), F.lit("f1")),
        F.array(F.lit("q1"), F.lit("q2")), F.array(F.when(key % 2 == 0, "q1").otherwise("none")), F.array(F.lit("q3"), F.lit("q2")),
    )
    return t("customer").select(key.alias("id"), F.array_join(facts, ",").alias("facts"), F.array_join(questions, ",").alias("questions"))


@query("SELECT conv_id, '# Carried over (' || max(turn) || ')' || chr(10) || 'kept' || chr(10) || '## Facts' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || '## Open questions' || chr(10) || '- c' AS prompt FROM conversations GROUP BY conv_id")
def cos_render(t):
    rows = t("conversations").groupBy("conv_id").agg(F.max("turn").alias("sequence"))
    return rows.select("conv_id", bank.rendered_summary(F.col("sequence"), F.lit("kept"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))).alias("prompt"))


# ---- deduplication

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), ch AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, sha256(line) AS chunk FROM lines WHERE trim(line) <> '')"


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(t):
    return D.exact_groups(t("documents"))


@query("WITH " + _LINES + ", f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) AS r, first_value(doc_id) OVER (PARTITION BY chunk ORDER BY doc_id, pos) AS ref_id FROM ch) SELECT doc_id, pos, CASE WHEN r = 1 THEN 'FULL' ELSE 'REF' END AS kind, ref_id FROM f")
def dedup_encode(t):
    return D.encode_refs(D.line_chunks(t("documents"))).select("doc_id", "pos", "kind", "ref_id")


@query("SELECT doc_id, sha256(text) AS whole FROM documents")
def cdc_rebuilt(t):
    return D.rebuilt(D.cdc_chunks(t("documents")), docs=t("documents"))


@query()
def cdc_chunks(t):
    return D.cdc_chunks(t("documents")).drop("data")


@query()
def dedup_encoded(t):
    coded = D.encoded(D.cdc_chunks(t("documents")))
    return coded.select("doc_id", "seq", "sha256", "token", F.size("deps").alias("n_deps"), F.octet_length("payload").alias("size"))


@query("SELECT doc_id, sha256(text) AS whole FROM documents WHERE strlen(text) > 0")
def dedup_decoded(t):
    return D.rebuilt(D.decoded(D.encoded(D.cdc_chunks(t("documents")))))


@query("WITH " + _LINES + ", o AS (SELECT chunk, count(*) AS refs, max(length(line)) AS size FROM ch GROUP BY chunk) SELECT count(*) AS unique_chunks, CAST(sum(refs) AS BIGINT) AS total_refs, CAST(sum(size) AS BIGINT) AS unique_chars, round(sum(refs) / count(*), 6) AS dedup_ratio FROM o")
def dedup_stats(t):
    return D.store_stats(D.line_chunks(t("documents")))


_SETS = _LINES + ", s AS (SELECT DISTINCT doc_id, chunk FROM ch), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"


_REPS = _SETS + ", m AS (SELECT doc_id, string_agg(chunk, ',' ORDER BY chunk) AS mark FROM s GROUP BY 1), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY mark) AS rep FROM m), one AS (SELECT s.* FROM s JOIN r ON r.doc_id = s.doc_id AND rep = r.doc_id), k AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS shared FROM one a JOIN one b ON a.chunk = b.chunk AND a.doc_id < b.doc_id GROUP BY 1, 2)"


@query("WITH " + _REPS + " SELECT id_a, id_b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM k JOIN n x ON x.doc_id = id_a JOIN n y ON y.doc_id = id_b WHERE round(shared / (x.n + y.n - shared), 6) >= 0.3 UNION ALL SELECT rep, r.doc_id, n, 1.0 FROM r JOIN n USING (doc_id) WHERE rep <> r.doc_id")
def line_jaccard(t):
    return D.set_jaccard(D.line_chunks(t("documents")), "doc_id", "chunk")


@query("WITH " + _SETS + ", o AS (SELECT chunk FROM s WHERE doc_id = 0), k AS (SELECT doc_id, count(*) AS shared FROM s JOIN o USING (chunk) WHERE doc_id <> 0 GROUP BY 1) SELECT k.doc_id, shared, round(shared / (n.n + (SELECT count(*) FROM o) - shared), 6) AS jaccard FROM k JOIN n ON n.doc_id = k.doc_id WHERE round(shared / (n.n + (SELECT count(*) FROM o) - shared), 6) >= 0.05")
def find_similar(t):
    return D.similar_to(D.line_chunks(t("documents")), "doc_id", "chunk", 0, 0.05)


@query()
def simhash_nearest(t):
    return D.simhash_nearest(D.simhashes(t("documents")))


_CO = _LINES + ", co AS (SELECT a.chunk AS a, b.chunk AS b, count(*) AS cnt FROM ch a JOIN ch b ON a.doc_id = b.doc_id AND a.pos <> b.pos GROUP BY 1, 2)"


@query("WITH " + _CO + " SELECT a, b, cnt FROM co")
def cooccurrence(t):
    return D.cooccurrence(D.line_chunks(t("documents")))


@query("WITH " + _CO + ", k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cnt DESC, b) AS r FROM co) SELECT a, b, cnt, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 5")
def predicted_chunks(t):
    return D.predicted_chunks(D.line_chunks(t("documents")))


@query("WITH " + _LINES + ", o AS (SELECT chunk, count(*) AS refs, max(doc_id) % 100 AS last_seen FROM ch GROUP BY chunk), h AS (SELECT chunk FROM o WHERE refs >= 5 ORDER BY refs DESC, chunk LIMIT 10000) SELECT o.chunk, refs, CASE WHEN h.chunk IS NOT NULL THEN 'hot' WHEN refs < 5 AND 100 - last_seen > 30 THEN 'cold' ELSE 'warm' END AS tier FROM o LEFT JOIN h USING (chunk)")
def chunk_tiers(t):
    rows = D.line_chunks(t("documents")).groupBy("chunk").agg(F.count(F.lit(1)).alias("refs"), (F.max("doc_id") % 100).alias("last_seen"))
    return D.tiers(rows, now=100)


@query("WITH " + _LINES + " SELECT chunk, count(DISTINCT source) AS agents, count(*) AS refs, count(DISTINCT source) > 1 OR count(*) >= 5 AS shared FROM ch JOIN documents USING (doc_id) GROUP BY chunk")
def chunk_federation(t):
    docs = t("documents")
    return D.federation(D.line_chunks(docs).join(docs.select("doc_id", "source"), "doc_id"), "source")


_STATES = "o AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 11 <> 0)"


def _states(t):
    rows = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    new = rows.where("key % 11 <> 0").withColumn("value", F.when(F.col("key") % 5 == 0, "moved").otherwise(F.col("value")))
    return rows.where("key % 7 <> 0"), new


@query("WITH " + _STATES + " SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'delete' ELSE 'set' END AS op, n.value FROM o FULL JOIN n ON o.key = n.key WHERE n.key IS NULL OR o.key IS NULL OR o.value IS DISTINCT FROM n.value")
def kv_delta(t):
    return D.state_delta(*_states(t))


@query("WITH " + _STATES + " SELECT key, value FROM n")
def kv_delta_applied(t):
    old, new = _states(t)
    return D.applied(old, D.state_delta(old, new))


@query("WITH a AS (SELECT * FROM conversations WHERE turn <> 2), b AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN text || '.' ELSE text END AS text FROM conversations WHERE turn <> 0) SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, CASE WHEN a.conv_id IS NULL THEN 'added' WHEN b.conv_id IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn")
def forensic_diff(t):
    rows = t("conversations")
    b = rows.where("turn <> 0").withColumn("text", F.when(F.col("turn") == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return D.forensic_diff(rows.where("turn <> 2"), b, ["conv_id", "turn"], "text")


_OFTEN = "often AS (SELECT chunk FROM ch WHERE length(line) >= 40 GROUP BY chunk HAVING count(*) >= 3), o AS (SELECT l.doc_id, l.pos, l.line, CASE WHEN f.chunk IS NOT NULL THEN '«REF:' || f.chunk || '»' WHEN starts_with(l.line, '«REF:') OR starts_with(l.line, '«OWN»') THEN '«OWN»' || l.line ELSE l.line END AS out FROM lines l LEFT JOIN often f ON sha256(l.line) = f.chunk)"


@query("WITH " + _LINES + ", " + _OFTEN + " SELECT doc_id, string_agg(out, chr(10) ORDER BY pos) AS compact, CAST(floor(sum(length(line) - length(out)) / 4) AS BIGINT) AS saved FROM o GROUP BY doc_id")
def prompt_compaction(t):
    docs = t("documents")
    return D.compacted(docs, D.line_chunks(docs), least=40)


@query("SELECT doc_id, text FROM documents")
def prompt_expansion(t):
    docs = t("documents")
    chunks = D.line_chunks(docs)
    return D.expanded(D.compacted(docs, chunks, least=40), chunks)


# ---- texts

_CANON = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z?', '<TS>', 'g'), '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<UUID>', 'g'), '\\b[0-9a-fA-F]{16,}\\b', '<HEX>', 'g'), '\\b\\d{7,}\\b', '<INT>', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_CANON} AS canonical FROM documents")
def canonicalize_lossy(t):
    return t("documents").select("doc_id", T.canonicalize_lossy(F.col("text")).alias("canonical"))


@query("SELECT doc_id, text FROM documents")
def canonicalize_lossless(t):
    canonical, tokens = T.canonicalize_lossless(F.col("text"))
    return t("documents").select("doc_id", T.reinflate(canonical, tokens).alias("text"))


_KINDS = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "ssn": "\\b\\d{3}-\\d{2}-\\d{4}\\b", "credit_card": "\\b\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}\\b", "phone": "\\b\\d{3}[-. ]\\d{3}[-. ]\\d{4}\\b|\\(\\d{3}\\) ?\\d{3}[-. ]\\d{4}\\b", "ip": "\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _KINDS.items()) + " FROM documents")
def pii_counts(t):
    return t("documents").select("doc_id", *[T.pii_count(F.col("text"), k).alias(k) for k, _ in T.PII])


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value, true AS there FROM documents" for k, p in _KINDS.items()))
def pii_spans(t):
    docs = t("documents")
    spans = T.pii_spans(docs).join(docs.select("doc_id", "text"), "doc_id")
    return spans.select("doc_id", "kind", "value", (F.expr("substring(text, span_start + 1, span_end - span_start)") == F.col("value")).alias("there"))


_RED = "text"
for _k, _p in _KINDS.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '[{_k.upper()}]', 'g')"


@query(f"SELECT doc_id, {_RED} AS text FROM documents")
def pii_redact(t):
    return t("documents").select("doc_id", T.pii_redact(F.col("text")).alias("text"))


_SCORE = _LINES + r", w AS (SELECT doc_id, pos, unnest(list_distinct(regexp_extract_all(lower(line), '[\p{L}\p{N}]+'))) AS word FROM ch), f AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2), sc AS (SELECT w.doc_id, w.pos, avg(n) AS score FROM w JOIN f USING (doc_id, word) GROUP BY 1, 2), k AS (SELECT ch.doc_id, ch.pos, line, count(*) OVER (PARTITION BY ch.doc_id) AS n, row_number() OVER (PARTITION BY ch.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, ch.pos) AS r FROM ch LEFT JOIN sc ON sc.doc_id = ch.doc_id AND sc.pos = ch.pos)"
_PICK = " SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS summary, count(*) AS n_lines FROM k WHERE r <= {} GROUP BY doc_id"


@query("WITH " + _SCORE + _PICK.format("greatest(1, least(50, floor(n * 0.1)))"))
def auto_summary(t):
    return T.auto_summary(t("documents"))


@query("WITH " + _SCORE + _PICK.format("5"))
def gist(t):
    return T.gist(t("documents"))


@query("WITH " + _LINES + ", k AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN contains(lower(line), 'license') THEN 11 ELSE 1 END + CASE WHEN contains(lower(line), 'the') THEN 10 ELSE 0 END DESC, pos) AS r FROM ch)" + _PICK.format("20"))
def keyword_summary(t):
    return T.keyword_summary(t("documents"), ["License", "the"])


@query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: length(x) > 20)[1:3] AS c FROM documents) SELECT doc_id, array_to_string(c, '|') AS claims, len(c) AS n FROM s")
def claims(t):
    c = T.claims(F.col("text"))
    return t("documents").select("doc_id", F.array_join(c, "|").alias("claims"), F.size(c).cast("long").alias("n"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:2], chr(10)) AS skeleton, substr(sha256(text), 1, 10) AS fingerprint FROM documents")
def skeleton(t):
    return t("documents").select("doc_id", T.skeleton(F.col("text")).alias("skeleton"), T.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT o_orderkey, 'Decision: ' || o_orderpriority || chr(10) || 'Note: ' || o_orderstatus AS witnesses, 'tail' AS residual FROM orders")
def witnesses(t):
    text = F.concat_ws("\n", F.lit("Project: x"), F.concat(F.lit("Decision: "), "o_orderpriority"), F.lit("Goal: y"), F.concat(F.lit("Note: "), "o_orderstatus"), F.lit("tail"))
    return t("orders").select("o_orderkey", F.array_join(T.witnesses(text), "\n").alias("witnesses"), T.residual(text).alias("residual"))


@query("WITH " + _LINES + ", c AS (SELECT doc_id, line, count(*) AS n FROM ch GROUP BY 1, 2), s AS (SELECT doc_id, max(n) / sum(n) AS share FROM c GROUP BY 1) SELECT d.doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 WHEN strlen(text) < 100 THEN 3 WHEN share > 0.8 THEN 0 ELSE 3 END AS BIGINT) AS tier FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id")
def tier_select(t):
    return slots.auto_tier(t("documents"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN 0.95 WHEN p_size < 20 THEN 0.70 ELSE 0.0 END AS DOUBLE) AS confidence FROM part")
def tier_confidence(t):
    tier = F.when(F.col("p_size") < 10, 3).when(F.col("p_size") < 20, 0).otherwise(1)
    return t("part").select("p_partkey", T.confidence(tier).alias("confidence"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS idx, p AS content FROM (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents))")
def paragraph_chunks(t):
    return sessions.paragraphs(t("documents"))


@query("WITH " + _LINES + " SELECT doc_id, CAST(floor(pos / 8) AS INTEGER) AS idx, string_agg(line, chr(10) ORDER BY pos) AS content FROM lines GROUP BY 1, 2")
def line_group_chunks(t):
    return sessions.line_groups(t("documents"))


@query()
def chunk_text(t):
    return sessions.chunked(t("documents"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def whitespace_tokens(t):
    return t("documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer")
def encrypt_round_trip(t):
    key = F.lit(b"0123456789abcdef")
    return t("customer").select("c_custkey", T.decrypted(T.encrypted(F.col("c_name"), key), key).alias("c_name"))


@query("SELECT o_orderkey, rtrim(CASE WHEN o_totalprice > 100000 THEN 'ratio,' ELSE '' END || CASE WHEN o_custkey > 1000 THEN 'refs' ELSE '' END, ',') AS issues FROM orders")
def integrity_policy(t):
    return t("orders").select("o_orderkey", F.array_join(D.integrity_issues(F.col("o_totalprice") / 1000, F.col("o_custkey")), ",").alias("issues"))


# ---- sources

_JSON = "SELECT CAST(conv_id AS VARCHAR) AS file, turn, role, trim(text) AS content FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 20"


def _lines(t, flat: bool):
    body = F.struct(F.col("text").alias("content")) if flat else F.struct("role", F.col("text").alias("content"))
    record = F.struct(F.col("role").alias("type"), body.alias("message")) if flat else F.struct(F.lit("message").alias("type"), body.alias("message"))
    return t("conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), F.to_json(record).alias("line"))


_PARSED = "WITH m AS (" + _JSON + ") SELECT file, role, content, row_number() OVER (PARTITION BY file ORDER BY turn) - 1 AS idx FROM m"


@query(_PARSED)
def sessions_nested(t):
    return sessions.parse_lines(_lines(t, flat=False)).select("file", "role", "content", "idx")


# a file whose first record is of neither role is a generic one: all its texts, of unknown role
_FLAT = "WITH f AS (SELECT conv_id, arg_min(role, turn) IN ('user', 'assistant') AS flat FROM conversations GROUP BY 1), m AS (SELECT CAST(conv_id AS VARCHAR) AS file, turn, CASE WHEN flat THEN role ELSE 'unknown' END AS role, trim(CASE WHEN flat THEN text ELSE substr(text, 1, 5000) END) AS content FROM conversations JOIN f USING (conv_id) WHERE NOT flat OR role IN ('user', 'assistant')) SELECT file, role, content, row_number() OVER (PARTITION BY file ORDER BY turn) - 1 AS idx FROM m WHERE length(content) >= 20"


@query(_FLAT)
def sessions_flat(t):
    return sessions.parse_lines(_lines(t, flat=True)).select("file", "role", "content", "idx")


@query("WITH g AS (SELECT CAST(page_id AS VARCHAR) AS file, regexp_replace(substr(html || chr(10) || url || chr(10) || 'seen on ' || url, 1, 5000), '^\\s+|\\s+$', '', 'g') AS content FROM pages) SELECT file, 'unknown' AS role, content FROM g WHERE length(content) >= 20")
def sessions_generic(t):
    record = F.struct(F.col("html").alias("content"), F.array(F.col("url"), F.concat(F.lit("seen on "), "url")).alias("summary"), F.lit("left out").alias("other"))
    lines = t("pages").select(F.col("page_id").cast("string").alias("file"), F.lit(0).cast("long").alias("line_no"), F.to_json(record).alias("line"))
    return sessions.parse_lines(lines).select("file", "role", "content")


@query("WITH m AS (" + _JSON + "), i AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY turn) - 1 AS idx FROM m) SELECT sha256(file || '|' || idx || '|' || content) AS id, file AS session_id, role, idx FROM i")
def sessions_stored(t):
    return sessions.stored(sessions.parse_lines(_lines(t, flat=False))).select("id", "session_id", "role", "idx")


@query("SELECT conv_id, turn, role, text AS content FROM conversations")
def message_adapter(t):
    lines = store.message_lines(t("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))).select("conv_id", "turn", "line")
    return store.line_messages(lines).select("conv_id", "turn", "role", "content")


@query("SELECT event_id, event_type AS name, CAST(user_id AS VARCHAR) AS trace_id, props AS attr FROM events")
def span_adapter(t):
    e = t("events").select("event_id", F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("ok").alias("status"), F.create_map(F.lit("p"), F.col("props")).alias("attributes"))
    back = store.line_spans(store.span_lines(e).select("event_id", "line"))
    return back.select("event_id", "name", F.col("fields")["trace_id"].alias("trace_id"), F.col("fields")["p"].alias("attr"))


@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def embedding_cache_misses(t):
    docs = t("documents").select("doc_id", F.col("text").alias("content"))
    cache = docs.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("text_hash"), F.lit("m").alias("model")).distinct()
    return store.missing_embeddings(docs.where("doc_id % 3 <> 0"), cache, "m").select("text_hash")


@query()
def embeddings_made(t):
    return t("documents").select("doc_id", store.embedder(64)(F.col("text")).alias("embedding"))


@query()
def vault_methods(t):
    files = t("pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return store.vault_stats(store.vault(files))


@query("SELECT url AS path, html FROM pages")
def vault_round_trip(t):
    files = t("pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return store.unvaulted(store.vault(files)).select("path", F.col("content").cast("string").alias("html"))


@query("SELECT sha256(html) AS content_hash, url AS path, strlen(html) AS size_bytes FROM pages")
def vault_files(t):
    files = t("pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return store.vault(files).select("content_hash", "path", "size_bytes")


# ---- streaming


def _stream(name: str, table: str, make, sql: str | None, mode: str = "append") -> None:
    def run(spark, sf_dir):
        path = f"{sf_dir}/{table}.parquet"
        schema = spark.read.parquet(path).schema
        return trackers.drained(make(trackers.events_stream(spark, path, schema)), mode)

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


_BY_ID = _GRAMS.replace("ORDER BY ts, event_id", "ORDER BY event_id")
_stream("stream_motif_tracker", "events", trackers.motif_tracker, "WITH " + _BY_ID.replace("row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS start", "event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS start") + ", s AS (SELECT user_id, start + n - 1 AS place, n, row_number() OVER (PARTITION BY user_id, motif ORDER BY start) AS times FROM g) SELECT s.user_id AS key, e AS at, CAST(max(n) AS INTEGER) AS longest FROM s JOIN o ON o.user_id = s.user_id AND o.start = s.place WHERE times >= 2 GROUP BY 1, 2")
_stream("stream_ratio_monitor", "events", trackers.ratio_monitor, "WITH " + _Z.replace("ORDER BY ts, event_id", "ORDER BY event_id") + " SELECT user_id AS key, event_id AS at, z FROM zz WHERE z IS NOT NULL")


@query("SELECT conv_id AS key, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id")
def stream_chunks(t):
    rows = t("conversations")
    path = rows.inputFiles()[0].rsplit("conversations.parquet", 1)[0] + "conversations.parquet"
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("end"))
    stream = trackers.events_stream(rows.sparkSession, path, rows.schema).join(ends, "conv_id").withColumn("last", F.col("turn") == F.col("end"))
    return trackers.drained(trackers.chunk_stream(stream, last="last")).groupBy("key").agg(F.sum("size").alias("bytes"))


_stream("stream_windows", "events", lambda s: trackers.windowed_counts(s).withColumn("total", F.round("total", 4)), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", "complete")
_stream("stream_agents", "events", lambda s: trackers.merged_agents({"a": s.where("user_id % 2 = 0"), "b": s.where("user_id % 2 = 1")}).select("event_id", "agent"), "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS agent FROM events")
