"""Queries of the log language and of log search, over events as log rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from memquarry.functions import bloom, text as T
from memquarry.operators import cql, logs, slots
from memquarry.operators.keyword_index import indexed
from memquarry.plans.registry import LOG_SQL, TRACE_SQL, log_rows, query, trace_lines

W = "WITH " + LOG_SQL


def _cql(name: str, statement: str, sql: str) -> None:
    def f(t):
        out = cql.execute(log_rows(t("events")), statement)
        return out.select(F.round("value", 6).alias("value")) if " avg(" in statement else out

    f.__name__ = name
    query(W + " " + sql)(f)


_cql("cql_lines_like", "SELECT lines WHERE text LIKE '%PURCHASE%'", "SELECT line_no, text FROM log WHERE text ILIKE '%PURCHASE%'")
_cql("cql_not_like", "SELECT lines WHERE NOT text LIKE 'event v%'", "SELECT line_no, text FROM log WHERE NOT text ILIKE 'event v%'")
_cql("cql_count", "SELECT count() WHERE slot[0] = 'error'", "SELECT count(*) AS value FROM log WHERE event_type = 'error'")
_cql("cql_avg", "SELECT avg(slot[2]) WHERE slot[0] = 'view'", "SELECT round(avg(CAST(value AS DOUBLE)), 6) AS value FROM log WHERE event_type = 'view'")
_cql("cql_min", "SELECT min(slot[2])", "SELECT min(CAST(value AS DOUBLE)) AS value FROM log")
_cql("cql_max", "SELECT max(slot[2]) WHERE template LIKE 'event%'", "SELECT max(CAST(value AS DOUBLE)) AS value FROM log")
_cql("cql_avg_not_numeric", "SELECT avg(slot[0])", "SELECT CAST(NULL AS DOUBLE) AS value")
_cql("cql_and_or", "SELECT lines WHERE (slot[0] = 'click' OR slot[0] = 'view') AND slot[2] > 100", "SELECT line_no, text FROM log WHERE event_type IN ('click', 'view') AND CAST(value AS DOUBLE) > 100")
_cql("cql_numeric_cmp", "SELECT count() WHERE slot[1] <= 50 AND slot[2] >= 10.5", "SELECT count(*) AS value FROM log WHERE CAST(user_id AS DOUBLE) <= 50 AND CAST(value AS DOUBLE) >= 10.5")
_cql("cql_string_cmp", "SELECT lines WHERE slot[0] >= 'purchase'", "SELECT line_no, text FROM log WHERE event_type >= 'purchase'")
_cql("cql_mixed_cmp", "SELECT count() WHERE slot[0] > 5 OR slot[0] != 7", "SELECT count(*) AS value FROM log")
_cql("cql_not_cmp", "SELECT count() WHERE NOT slot[2] < 50", "SELECT count(*) AS value FROM log WHERE NOT CAST(value AS DOUBLE) < 50")
_cql("cql_slot_beyond", "SELECT count() WHERE slot[9] = ''", "SELECT count(*) AS value FROM log")
_cql("cql_limit", "SELECT count() WHERE slot[0] = 'view' LIMIT 25", "SELECT count(*) AS value FROM (SELECT 1 FROM log WHERE event_type = 'view' ORDER BY line_no LIMIT 25)")
_cql("cql_limit_lines", "SELECT lines LIMIT 40", "SELECT line_no, text FROM log ORDER BY line_no LIMIT 40")

TEMPLATES = [(1, "event purchase user=<*> value=<*>"), (2, "event error user=<*> value=<*>"), (3, "event <*> user=<*> value=<*>")]


def _events(t):
    return logs.match_templates(log_rows(t("events")).select("line_no", F.col("text").alias("line")), TEMPLATES)


_EVENT = "CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS BIGINT)"


@query(W + f" SELECT line_no, {_EVENT} AS event_id, CASE WHEN event_type IN ('purchase', 'error') THEN user_id || '|' || value ELSE event_type || '|' || user_id || '|' || value END AS params FROM log")
def template_match(t):
    return _events(t).select("line_no", "event_id", F.array_join("params", "|").alias("params"))


@query(W + f" SELECT {_EVENT} AS event_id, count(*) AS lines FROM log GROUP BY 1")
def template_counts(t):
    return _events(t).groupBy("event_id").agg(F.count(F.lit(1)).alias("lines"))


@query(W + " SELECT line_no, text AS line FROM log WHERE event_type = 'error'")
def event_id_recall(t):
    return logs.recall_event(_events(t), 2).select("line_no", "line")


@query(W + " SELECT line_no, text AS line FROM log WHERE event_type = 'purchase' ORDER BY line_no LIMIT 30")
def event_id_recall_limit(t):
    return logs.recall_event(_events(t), 1, 30).select("line_no", "line")


@query(W + " SELECT line_no, text FROM log")
def template_render(t):
    rows = log_rows(t("events"))
    return rows.select("line_no", logs.render(F.col("template"), F.col("slots")).alias("text"))


@query(W + " SELECT line_no, text AS line FROM log WHERE text LIKE '%error%' AND text LIKE '%user=1%'")
def keyword_all(t):
    return logs.keyword_filter(log_rows(t("events")).select("line_no", F.col("text").alias("line")), "ERROR user=1")


@query(W + " SELECT line_no, text AS line FROM log WHERE text LIKE '%signup%' OR text LIKE '%user=77%'")
def keyword_any(t):
    rows = log_rows(t("events")).select("line_no", F.col("text").alias("line"))
    return logs.keyword_filter(rows, "signup user=77", every=False)


def _named(t):
    return _events(t).withColumn("template", F.coalesce(*[F.when(F.col("event_id") == e, F.lit(s)) for e, s in TEMPLATES]))


@query(W + " SELECT line_no, text AS line FROM log WHERE text LIKE '%purchase%' AND text LIKE '%user=9%'")
def keyword_fast(t):
    return logs.fast_filter(_named(t), "purchase user=9").select("line_no", "line")


@query(W + " SELECT line_no FROM log WHERE regexp_matches(text, '(^|[^A-Za-z0-9_./:-])error($|[^A-Za-z0-9_./:-])') AND regexp_matches(text, '(^| )user($|=)') AND contains(text, '=7 ')")
def keyword_two_level(t):
    rows = logs.packets(log_rows(t("events")).select("line_no", F.col("text").alias("line")), 500)
    found = logs.two_level(rows, indexed(rows, "packet", "line", T.log_tokens), ["error", "user"])
    return found.where(F.col("line").contains("=7 ")).select("line_no")


@query(W + " SELECT CAST(floor(line_no / 500) AS BIGINT) AS packet, count(*) AS lines FROM log WHERE floor(line_no / 500) >= 2 AND floor(line_no / 500) < 6 GROUP BY 1")
def packet_range(t):
    rows = logs.packets(log_rows(t("events")), 500)
    return logs.packet_range(rows, 2, 6).groupBy("packet").agg(F.count(F.lit(1)).alias("lines"))


@query(W + " SELECT token, count(DISTINCT floor(line_no / 500)) AS packets FROM (SELECT line_no, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_./:-]{2,}')) AS token FROM log) GROUP BY token")
def token_df(t):
    rows = logs.packets(log_rows(t("events")), 500)
    one = rows.select("packet", F.explode(F.array_distinct(T.log_tokens(F.col("text")))).alias("token")).distinct()
    return logs.document_frequency(one)


@query(W + " SELECT DISTINCT CAST(floor(line_no / 500) AS BIGINT) AS packet FROM log WHERE event_type IN ('signup', 'purchase') INTERSECT SELECT DISTINCT CAST(floor(line_no / 500) AS BIGINT) FROM log WHERE event_type = 'error'")
def packet_query(t):
    rows = logs.packets(log_rows(t("events")).select("line_no", F.col("text").alias("line")), 500)
    return logs.packets_for(logs.token_postings(rows), [["signup", "purchase"], ["error"]])


@query("WITH " + TRACE_SQL + " SELECT line_no, tool, regexp_extract(line, 'rid=([^ ]+)', 1) AS rid, props AS payload FROM trace")
def trace_parse(t):
    return logs.parse_trace(trace_lines(t("events"))).select("line_no", "tool", "rid", "payload")


def _trace(t):
    return logs.parse_trace(trace_lines(t("events")))


@query("WITH " + TRACE_SQL + " SELECT line_no, line FROM trace WHERE tool IN ('click', 'signup')")
def tool_filter(t):
    return _trace(t).where(F.col("tool").isin("click", "signup")).select("line_no", "line")


@query("WITH " + TRACE_SQL + " SELECT line_no, 'k' AS path, props->>'$.k' AS value, 'number' AS kind FROM trace WHERE props->>'$.k' IS NOT NULL")
def payload_flatten(t):
    return logs.flatten_payload(_trace(t), "line_no")


@query("WITH " + TRACE_SQL + " SELECT line_no, line FROM trace WHERE tool = 'view' AND CAST(props->>'$.k' AS DOUBLE) = 7")
def structured_predicates(t):
    rows = _trace(t)
    tests = [logs.structured(p) for p in ("tool:VIEW", "k:k", "n:k=7")]
    return rows.where(tests[0] & tests[1] & tests[2]).select("line_no", "line")


@query("WITH " + TRACE_SQL + " SELECT line_no, line FROM trace WHERE props->>'$.k' = '12'")
def structured_kv(t):
    return _trace(t).where(logs.structured("kv:k=12") & logs.structured("v:12")).select("line_no", "line")


@query("WITH " + TRACE_SQL + " SELECT line_no FROM trace WHERE lower(line) LIKE '%purcha%' OR lower(line) LIKE '%purch%'")
def plain_keyword(t):
    return _trace(t).where(logs.plain("Purchases")).select("line_no")


@query("WITH " + TRACE_SQL + " SELECT line_no FROM trace WHERE tool = 'click' AND line LIKE '%=u37 %'")
def recall_all(t):
    return logs.recall(_trace(t), ["tool:click", "=u37 "]).select("line_no")


@query("WITH " + TRACE_SQL + " SELECT line_no FROM trace WHERE tool = 'click' OR line LIKE '%signu%'")
def recall_any(t):
    return logs.recall(_trace(t), ["tool:click", "signup"], require_all=False).select("line_no")


@query("WITH s AS (SELECT event_id, user_id, row_number() OVER w AS seq, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, seq, CAST(total AS BIGINT) AS total FROM s WHERE seq = 1 OR (seq <= 8 AND total <= 60)")
def budgeted_scan(t):
    rows = t("events").select("user_id", "event_id", F.length("props").cast("long").alias("size"))
    return logs.budgeted(rows, 8, 60, "event_id", "size", "user_id").select("user_id", "event_id", F.col("seq").cast("long").alias("seq"), "total")


@query("WITH m AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT 'flag <*> status <*> end' AS template, CAST(sum(n) AS BIGINT) AS n FROM m")
def template_mining(t):
    rows = t("lineitem").select(F.concat(F.lit("flag "), "l_returnflag", F.lit(" status "), "l_linestatus", F.lit(" end")).alias("line"))
    return logs.mine_templates(rows)


_MINED = "words AS (SELECT event_id AS line_no, list_transform([event_type, 'happened', 'to', CAST(user_id AS VARCHAR), 'with'] || string_split(props, ' '), lambda x: x) AS tok FROM events), placed AS (SELECT line_no, len(tok) AS n, tok[1] AS head, unnest(tok) AS token, generate_subscripts(tok, 1) AS pos FROM words), sizes AS (SELECT len(tok) AS n, tok[1] AS head, count(*) AS lines FROM words GROUP BY 1, 2), shares AS (SELECT unnest([{}]) AS share), usual AS (SELECT share, n, head, pos, token FROM (SELECT n, head, pos, token, count(*) AS k FROM placed GROUP BY ALL) JOIN sizes USING (n, head), shares WHERE k >= share * lines - 1e-9), shaped AS (SELECT s.share, p.line_no, string_agg(CASE WHEN u.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.pos) AS template, count(*) FILTER (u.token IS NULL) AS holes, string_agg(CASE WHEN u.token IS NULL THEN p.token END, '|' ORDER BY p.pos) AS slots FROM placed p CROSS JOIN shares s LEFT JOIN usual u ON u.share = s.share AND u.n = p.n AND u.head = p.head AND u.pos = p.pos AND u.token = p.token GROUP BY 1, 2), mined AS (SELECT share, template, any_value(holes) AS holes, count(*) AS k FROM shaped GROUP BY 1, 2), cost AS (SELECT share, count(*) AS templates, CAST(sum(holes) AS BIGINT) AS slots, CAST(sum(k) AS BIGINT) AS lines, round(sum(k) / count(*), 6) AS reuse, round(count(*) + 0.1 * sum(holes), 6) AS cost FROM mined GROUP BY share)"


def _happenings(t):
    return t("events").select(F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" happened to "), F.col("user_id").cast("string"), F.lit(" with "), "props").alias("line"))


@query("WITH " + _MINED.format("CAST(1.0 AS DOUBLE)") + " SELECT templates, slots, lines, CAST(reuse AS DOUBLE) AS reuse, CAST(cost AS DOUBLE) AS cost FROM cost")
def template_stats(t):
    return logs.template_stats(logs.mine_templates(_happenings(t)))


@query("WITH " + _MINED.format("CAST(1.0 AS DOUBLE)") + " SELECT line_no, template, coalesce(slots, '') AS slots FROM shaped")
def mined_slots(t):
    return logs.templated(_happenings(t)).select("line_no", "template", F.array_join("slots", "|").alias("slots"))


@query("WITH " + _MINED.format("CAST(0.05 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.8 AS DOUBLE)") + " SELECT share, templates, slots, lines, CAST(reuse AS DOUBLE) AS reuse, CAST(cost AS DOUBLE) AS cost FROM cost")
def template_tuning(t):
    return logs.tune(_happenings(t), shares=(0.05, 0.2, 0.8))


@query(W + " SELECT line_no, text AS line FROM log WHERE text LIKE '%error user=1%'")
def keyword_scan(t):
    return logs.scan_filter(log_rows(t("events")).select("line_no", F.col("text").alias("line")), "Error USER=1")


@query(W + " SELECT line_no, text AS line, 'fast' AS route FROM log WHERE text LIKE '%purchase%' AND text LIKE '%user=9%'")
def keyword_routed(t):
    return logs.routed(_named(t), "purchase user=9").select("line_no", "line", "route")


@query(W + " SELECT line_no, text AS line, 'keyword' AS route FROM log WHERE text LIKE '%=11%'")
def keyword_routed_on(t):
    return logs.routed(_named(t), "=11").select("line_no", "line", "route")


@query("WITH " + LOG_SQL + ", t AS (SELECT DISTINCT CAST(floor(line_no / 500) AS BIGINT) AS packet, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_./:-]{2,}')) AS token FROM log) SELECT packet, count(*) AS tokens, count(*) AS hits FROM t GROUP BY packet")
def bloom_members(t):
    rows = logs.packets(log_rows(t("events")), 500)
    tokens = rows.select("packet", F.explode(F.array_distinct(T.log_tokens(F.col("text")))).alias("token")).distinct()
    filters = bloom.blooms(tokens, "packet", bits=32_768)
    hit = bloom.might_hold(F.col("bloom"), F.col("token"), 32_768)
    return tokens.join(filters, "packet").groupBy("packet").agg(F.count(F.lit(1)).alias("tokens"), F.sum(hit.cast("long")).alias("hits"))


@query()
def bloom_false_positives(t):
    rows = logs.packets(log_rows(t("events")), 500)
    tokens = rows.select("packet", F.explode(F.array_distinct(T.log_tokens(F.col("text")))).alias("token")).distinct()
    unseen = t("customer").select(F.concat(F.lit("unseen-"), F.col("c_custkey").cast("string")).alias("token"))
    return bloom.false_positive_rate(bloom.blooms(tokens, "packet", bits=32_768), unseen, bits=32_768)


@query("SELECT 'job <*> ended on <*> after <*>' AS merged, count(*) AS n FROM events GROUP BY 1")
def template_merge(t):
    rows = t("events").select(logs.merge_templates(F.lit("job a1 ended on <*> after 3s"), F.lit("job b2 ended on web after 4s")).alias("merged"))
    return rows.groupBy("merged").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) AS dec_id, CAST(o_orderkey AS BIGINT) AS e_id, CAST(o_orderkey AS BIGINT) AS hex_id FROM orders")
def event_id_parse(t):
    key = F.col("o_orderkey")
    rows = t("orders").select(key.alias("id"), key.cast("string").alias("a"), F.concat(F.lit("E"), key.cast("string")).alias("b"), F.concat(F.lit("0x"), F.hex(key)).alias("c"))
    return rows.select("id", *[T.event_number(F.col(x)).alias(n) for x, n in (("a", "dec_id"), ("b", "e_id"), ("c", "hex_id"))])


_SLOTS = W + ", slot AS (SELECT line_no, 0 AS slot, event_type AS value FROM log UNION ALL SELECT line_no, 1, user_id FROM log UNION ALL SELECT line_no, 2, value FROM log)"
_MODEL = _SLOTS + ", c AS (SELECT slot, value, count(*) AS hits, min(line_no) AS first FROM slot GROUP BY 1, 2), m AS (SELECT *, CAST(sum(hits) OVER (PARTITION BY slot) AS BIGINT) AS total, row_number() OVER (PARTITION BY slot ORDER BY hits DESC, first) AS r FROM c)"


@query(_MODEL + " SELECT slot, value, hits, total, round(hits / total, 6) AS accuracy FROM m WHERE r = 1")
def slot_model(t):
    return slots.slot_model(log_rows(t("events")))


@query(_MODEL + ", h AS (SELECT s.slot, s.value, CASE WHEN s.value = m.value THEN 1.0 ELSE 0.0 END AS hit FROM slot s JOIN m ON s.slot = m.slot AND m.r = 1) SELECT slot, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, round(sum(strlen(value)) / sum(CAST(1 + (1 - hit) * strlen(value) AS DOUBLE)), 6) AS ratio FROM h GROUP BY slot")
def slot_prediction(t):
    rows = log_rows(t("events"))
    return slots.slot_prediction(rows, slots.slot_model(rows))


@query(_SLOTS + " SELECT slot, CASE WHEN count(*) FILTER (regexp_matches(value, '^-?[0-9]+$')) >= 50 AND count(*) = count(*) FILTER (regexp_matches(value, '^-?[0-9]+$')) THEN 'INT' ELSE 'DICT' END AS kind FROM slot GROUP BY slot")
def slot_types(t):
    return slots.slot_types(log_rows(t("events")))


@query(_SLOTS + " SELECT slot, CASE WHEN bool_and(regexp_matches(value, '^-?[0-9]+$')) THEN 'INT' WHEN bool_and(regexp_matches(value, '^[0-9a-fA-F]{6,}$')) THEN 'HEX' WHEN count(*) - count(DISTINCT value) >= 12 THEN 'DICT' ELSE 'RAW' END AS kind FROM slot GROUP BY slot")
def channel_types(t):
    return slots.channel_types(log_rows(t("events")))
