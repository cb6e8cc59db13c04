"""Operators against plain Python, round trips, and the cases that SQL queries don't cover."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memquarry.functions import text as T
from memquarry.operators import bank, dedup as D, logs, retrieval as R, sequence as S
from memquarry.sources import sessions, store


def slow_cuts(data, least, most, mask):
    out, fp, start = [], 0, 0
    for i, b in enumerate(data):
        fp = (fp << 1) ^ b
        n = i + 1 - start
        if n >= least and (fp & mask) == 0 or n >= most:
            out.append(i + 1)
            start = i + 1
    return out if not data or out and out[-1] == len(data) else [*out, len(data)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_cut_points_follow_the_definition(data):
    assert D.cut_points(data, 64, 512, 63) == slow_cuts(data, 64, 512, 63)


def test_cuts_survive_an_edit_in_front():
    import random

    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(200_000))
    digests = lambda d: {hashlib.sha256(d[a:b]).hexdigest() for a, b in zip([0, *D.cut_points(d)], D.cut_points(d))}
    a, b = digests(data), digests(b"inserted" + data)
    assert len(a & b) >= len(a) - 3


def test_simhash():
    text = b"the quick brown fox jumps over the lazy dog, again and again, near the river " * 4
    assert D.simhash64(b"abc") == 0
    assert D.simhash64(text) == D.simhash64(bytes(text))
    near = bin((D.simhash64(text) ^ D.simhash64(text.replace(b"river", b"lake"))) & (2**64 - 1)).count("1")
    far = bin((D.simhash64(text) ^ D.simhash64(bytes(range(256)))) & (2**64 - 1)).count("1")
    assert near <= 8 < far


def test_delta_round_trip():
    old, new = b"a long first version " * 50, b"a long second version " * 50
    assert D.restore_bytes(D.delta_bytes(new, old), old) == new
    with pytest.raises(ValueError):
        D.restore_bytes(D.delta_bytes(new, old), old + b"x")


def test_chunk_text():
    spaced = "word " * 900
    assert all(not c.startswith("ord") and c.endswith("word") for c in sessions.chunk_text(spaced)[:-1]) and len(sessions.chunk_text(spaced)) > 2
    assert sessions.chunk_text("short") == ["short"] and sessions.chunk_text("") == [] and sessions.chunk_text(None) == []
    parts = sessions.chunk_text("x" * 3700)
    assert all(len(p) <= 2000 for p in parts) and sum(map(len, parts)) >= 3700
    parts = sessions.chunk_text("a" * 1500 + "\n\n" + "b" * 1500)
    assert parts[0] == "a" * 1500 and parts[1].endswith("b")


def test_sessions(spark, tmp_path):
    nested = [
        {"type": "session", "id": 1},
        {"type": "message", "message": {"role": "user", "content": "please look at the file for me"}},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "reading the file as asked"}, {"type": "tool_use", "name": "read", "input": {"path": "/a", "n": 3}}]}},
        {"type": "message", "message": {"role": "toolResult", "content": "contents of the file are these"}},
        {"type": "message", "message": {"role": "user", "content": "short"}},
    ]
    flat = [{"type": "user", "message": {"content": "a question that is long enough"}}, {"type": "assistant", "message": {"content": ["an answer that is long", "enough"]}}]
    (tmp_path / "s1.jsonl").write_text("not json\n" + "\n".join(map(json.dumps, nested)) + "\n[1, 2]\n")
    (tmp_path / "s2.jsonl").write_text("\n".join(map(json.dumps, flat)) + "\n")
    (tmp_path / "s3.jsonl").write_text(json.dumps({"summary": "something said at some length", "other": 1}) + "\n")
    rows = sessions.read_sessions(spark, str(tmp_path)).orderBy("file", "idx").collect()
    by = lambda n: [(r["role"], r["content"], r["idx"]) for r in rows if r["file"].endswith(n)]
    assert by("s1.jsonl") == [
        ("user", "please look at the file for me", 0), ("assistant", "reading the file as asked", 1), ("tool", "Tool: read\n  path: /a\n  n: 3", 2), ("tool_result", "contents of the file are these", 3),
    ]
    assert by("s2.jsonl") == [("user", "a question that is long enough", 0), ("assistant", "an answer that is long\nenough", 1)]
    assert by("s3.jsonl") == [("unknown", "something said at some length", 0)]
    stored = sessions.stored(sessions.read_sessions(spark, str(tmp_path)))
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4


def test_templates_of_a_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("EventId,EventTemplate\nE5,took <*> ms\n0x1F,[*] failed\nbad,x\n")
    got = {r["template"]: r["event_id"] for r in sessions.read_templates(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"took <*> ms": 5, "[*] failed": 31, "x": None}


def test_template_priority_and_unknown(spark):
    lines = spark.createDataFrame([(0, "put a in b"), (1, "put a"), (2, "other"), (3, None)], "line_no long, line string")
    got = {r["line_no"]: (r["event_id"], r["params"]) for r in logs.match_templates(lines, [(1, "put <*>"), (2, "put <*> in <*>"), (3, "put a in b")]).collect()}
    assert got == {0: (3, []), 1: (1, ["a"]), 2: (None, []), 3: (None, [])}


def test_payloads(spark):
    rows = spark.createDataFrame([(0, '{"a": {"b": [1, "x", true]}, "c": null, "t": "NVDA"}'), (1, "{bad"), (2, None)], "line_no long, payload string").withColumn("tool", F.lit("Web.Open"))
    got = {(r["path"], r["value"], r["kind"]) for r in logs.flatten_payload(rows, "line_no").collect()}
    assert got == {("a.b[0]", "1", "number"), ("a.b[1]", "x", "string"), ("a.b[2]", "true", "bool"), ("c", None, "null"), ("t", "NVDA", "string")}
    hits = lambda p: [r["line_no"] for r in rows.where(logs.structured(p)).collect()]
    assert hits("kv:t=nvda") == [0] and hits("n:a.b[0]=1") == [0] and hits("n:a.b[2]=1") == [0] and hits("k:zz") == [] and hits("tool:web.open") == [0, 1, 2]
    with pytest.raises(ValueError):
        logs.structured("zz:1")


def test_keywords_any_is_not_pruned(spark):
    rows = spark.createDataFrame([(0, "alpha one"), (1, "beta two"), (2, "gamma")], "line_no long, line string")
    assert [r["line_no"] for r in logs.keyword_filter(rows, "alph BETA", every=False).orderBy("line_no").collect()] == [0, 1]
    assert logs.keyword_filter(rows, "alph beta").count() == 0 and logs.keyword_filter(rows, " ").count() == 0


def test_stems():
    assert [logs.stem(w) for w in ("searching", "used", "boxes", "cats", "is", "sing")] == ["search", "used", "box", "cat", "is", "sing"]


def test_augment_and_dedup(spark):
    hits = spark.createDataFrame([(1, "Same text", "user", 0.9, "s1"), (2, " same TEXT ", "user", 0.8, None), (3, "other", None, 0.7, "s2"), (4, "low", "user", 0.001, "s1")], "id long, content string, role string, score double, session_id string")
    assert [r["id"] for r in R.augment(hits, 5, ["user"]).collect()] == [1]
    assert [r["id"] for r in R.augment(hits, 5, ["user", "unknown"]).collect()] == [1, 3]
    assert [r["id"] for r in R.recall(hits, 5, "s1").collect()] == [1, 4]
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, [])], "id long, chunks array<string>")
    assert [r["id"] for r in R.distinct_by_overlap(hits.select("id", "score"), sets).orderBy(F.desc("score")).collect()] == [1, 3, 4]


def test_chain_localises_a_change(spark):
    rows = spark.createDataFrame([(1, i, f"packet {i}") for i in range(6)], "s int, n int, p string")
    links = S.hash_chain(rows, "s", "n", "p")
    acc = bytes(32)
    want = []
    for i in range(6):
        acc = hashlib.sha256(acc + hashlib.sha256(f"packet {i}".encode()).digest()).digest()
        want.append(acc.hex())
    assert [r["link"] for r in links.orderBy("place").collect()] == want
    changed = rows.withColumn("p", F.when(F.col("n") == 3, "forged").otherwise(F.col("p")))
    assert [r["ok"] for r in S.verify_chain(changed, links, "s", "n", "p").orderBy("place").collect()] == [True] * 3 + [False] + [True] * 2


def test_chains_with_a_cycle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "id long, nxt long")
    got = {r["node"]: r["last"] for r in bank.chains(links, "id", "nxt").collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: None, 5: None}


def test_state_delta_round_trip(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, value string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4")], "key string, value string")
    delta = D.state_delta(old, new)
    assert {(r["key"], r["op"]) for r in delta.collect()} == {("b", "set"), ("c", "delete"), ("d", "set")}
    assert {tuple(r) for r in D.applied(old, delta).collect()} == {tuple(r) for r in new.collect()}


def test_lossless_canonical_form_keeps_the_order_of_mixed_types(spark):
    text = "id 12345678 at 2024-01-02T03:04:05Z by 123e4567-e89b-12d3-a456-426614174000 then 99999999"
    c, t = T.canonicalize_lossless(F.col("x"))
    r = spark.createDataFrame([(text,)], "x string").select(c.alias("c"), t.alias("t"), T.reinflate(c, t).alias("back")).first()
    assert r["t"] == ["12345678", "2024-01-02T03:04:05Z", "123e4567-e89b-12d3-a456-426614174000", "99999999"]
    assert r["c"] == "id <@> at <@> by <@> then <@>" and r["back"] == text


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.table("chunks").count() == 0
    s.append("chunks", spark.createDataFrame([("c1", "hello", "user")], "id string, content string, role string"))
    s.append("chunks", spark.createDataFrame([("c2", "there")], "id string, content string"))
    s.audit("write", "chunk", "c1")
    assert s.table("chunks").count() == 2 and s.newest("audit_log").first()["action"] == "write"


def test_adapters(spark):
    rows = spark.createDataFrame([("user", "two\nlines \\n kept"), ("assistant", "")], "role string, content string")
    back = store.line_messages(store.message_lines(rows).select("line"))
    assert [(r["role"], r["content"]) for r in back.collect()] == [("user", "two\nlines \\n kept"), ("assistant", "")]
    assert store.line_messages(spark.createDataFrame([("free text",)], "line string")).first()["role"] == "unknown"


def test_vault_prefix(spark):
    files = spark.createDataFrame([("a", b"x" * 1000), ("b", b"small")], "path string, content binary")
    v = store.vault(files).cache()
    got = {r["path"]: r for r in v.collect()}
    assert got["a"]["method"] != "raw" and got["b"]["method"] == "raw"
    assert {r["path"]: bytes(r["content"]) for r in store.unvaulted(v).collect()} == {"a": b"x" * 1000, "b": b"small"}
    with pytest.raises(Exception, match="digest"):
        store.unvaulted(v.withColumn("content_hash", F.lit("no"))).collect()
    assert store.by_prefix(v, got["a"]["content_hash"][:10]).count() == 1 and store.by_prefix(v, "").count() == 0


def test_set_jaccard_of_many_copies_and_common_items(spark):
    """Groups of more than 64 copies, and pairs that share only an item of more than 64 sets."""
    sets = {i: {"a", "b"} for i in range(80)} | {100 + i: {"a", f"own {i}"} for i in range(10)} | {200: {"x", "y", "z"}, 201: {"x", "y", "w"}, 202: {"q"}}
    rows = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v] * 2, "doc_id long, chunk string")
    want, rep = {}, {a: min(b for b in sets if sets[b] == sets[a]) for a in sets}
    for a in sets:
        for b in sets:
            if a < b and (j := round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) >= 0.3 and (rep[b] == a or rep[a] == a and rep[b] == b):
                want[a, b] = (len(sets[a] & sets[b]), j)
    found = D.set_jaccard(rows, "doc_id", "chunk").collect()
    assert len(found) == len(want) and {(r["id_a"], r["id_b"]): (r["shared"], r["jaccard"]) for r in found} == want


def test_line_jaccard_same_as_sql(spark):
    import compare
    from memquarry.plans import registry, sequences  # noqa: F401

    folder = "/root/testdata/sf0.01"
    compare.same(registry.QUERIES["line_jaccard"](spark, folder), compare.tables(folder), registry.ORACLE_SQL["line_jaccard"])


def test_motif_encode_takes_every_repeated_run(spark):
    """400 distinct runs of three events, each seen twice with other events between, are all replaced."""
    seq, fresh = [], iter(range(10_000, 99_999))
    for i in [*range(400), *range(400)]:
        seq += [f"a{i}", f"b{i}", f"c{i}", f"x{next(fresh)}"]
    rows = spark.createDataFrame([(1, k, e) for k, e in enumerate(seq)], "user_id long, event_id long, event_type string")
    (row,) = S.motif_encode(rows, "user_id", ["event_id"], "event_type").collect()
    codes = [x for x in row["encoded"].split() if x.startswith("M")]
    assert len(codes) == 800 and len(set(codes)) == 400 and row["n_symbols"] == 1600 and row["savings"] == 0.5


def test_cooccurrence_of_all_ordered_pairs(spark):
    """Pairs further than five places apart, of either order, of a chunk with itself, and in copies of a document."""
    docs = {1: "abcdefghi", 2: "abcdefghi", 3: "iab", 4: "aab", 5: "z"}
    want = {}
    for d in docs.values():
        for i, x in enumerate(d):
            for j, y in enumerate(d):
                if i != j:
                    want[x, y] = want.get((x, y), 0) + 1
    rows = spark.createDataFrame([(k, i, c) for k, d in docs.items() for i, c in enumerate(d)], "doc_id long, pos int, chunk string")
    assert {(r["a"], r["b"]): r["cnt"] for r in D.cooccurrence(rows).collect()} == want


def test_chains_of_any_length_and_cycles(spark):
    n = 1200
    links = [(i, i + 1 if i < n - 1 else None) for i in range(n)] + [(5000, 5001), (5001, 5002), (5002, 5000), (6000, 5000), (7000, None), (8000, 9999)]
    got = {r["node"]: (r["last"], r["steps"], r["cyclic"]) for r in bank.chains(spark.createDataFrame(links, "id long, nxt long"), "id", "nxt").collect()}
    assert all(got[i] == (n - 1, n - 1 - i, False) for i in range(n))
    assert all(got[i][0] is None and got[i][2] for i in (5000, 5001, 5002, 6000)) and got[7000] == (7000, 0, False) and got[8000][::2] == (9999, False)
    assert bank.chains(spark.createDataFrame([], "id long, nxt long"), "id", "nxt").collect() == []


def test_motifs_decode_to_the_events(spark):
    import random

    r = random.Random(2)
    names = ["a", "b c", "M1", "M", "\\x", "\\M2", "Mx", "é"]
    rows = [(u, i, r.choice(names)) for u in range(6) for i in range(r.choice([1, 2, 50, 200]))]
    coded = S.motif_encode(spark.createDataFrame(rows, "user_id long, event_id long, event_type string"), "user_id", ["event_id"], "event_type")
    assert sorted(map(tuple, S.motif_decode(coded, "user_id").collect())) == sorted(rows)
    assert any(x["n_symbols"] < x["n_events"] for x in coded.collect())


def test_marks_of_a_texts_own_survive(spark):
    line = "a line of some length that occurs three times, so that it is taken out"
    digest = hashlib.sha256(line.encode()).hexdigest()
    texts = [(i, t) for i, t in enumerate([f"{line}\nx", f"{line}\n«REF:{digest}»", f"«OWN»«REF:{digest}»\n{line}\n«OWN»", "«REF:", ""])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    chunks = D.line_chunks(docs)
    small = D.compacted(docs, chunks, least=40)
    assert sorted(map(tuple, D.expanded(small, chunks).collect())) == texts and small.where(F.col("compact").contains(line)).count() == 0
    odd = spark.createDataFrame([("<@> at 2024-01-01 10:00:00 <@> id 123456789",), ("<@>",), ("",)], "t string")
    canonical, tokens = T.canonicalize_lossless(F.col("t"))
    assert all(r["t"] == r["u"] for r in odd.select("t", T.reinflate(canonical, tokens).alias("u")).collect())


def test_stream_chunks_do_not_depend_on_batches(spark, tmp_path):
    """The same pieces in one batch and in five give the same chunks, whose sizes add up to all bytes."""
    import random

    from memquarry.streaming import trackers

    r = random.Random(5)
    pieces = [(k, i, "".join(r.choice("abcdefgh \n") for _ in range(r.choice([0, 10, 900, 7000]))), False) for k in range(4) for i in range(10)]
    pieces = [(k, i, t, i == 9) for k, i, t, _ in pieces]
    found = []
    for n in (1, 5):
        folder = str(tmp_path / f"in{n}.parquet")
        for b in range(n):
            part = [p for p in pieces if p[1] * n // 10 == b]
            spark.createDataFrame(part, "conv_id long, turn long, text string, last boolean").coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.parquet(folder).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        rows = trackers.drained(trackers.chunk_stream(stream, last="last")).collect()
        found.append(sorted((x["key"], x["sha256"], x["size"], x["kind"]) for x in rows))
    assert found[0] == found[1]
    for k in range(4):
        data = "".join(t for key, _, t, _ in pieces if key == k).encode()
        cuts = [0, *D.cut_points(data)]
        assert sorted(x[1] for x in found[0] if x[0] == k) == sorted(hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:]))


def test_keyword_index(spark, tmp_path):
    """Appending and removing keep an index equal to one of what is left, and no text is read for a query."""
    from memquarry.operators.keyword_index import KeywordIndex

    rows = [(i, f"alpha foo_bar word{i % 3} " + "filler " * (i % 5)) for i in range(30)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "id long, body string")
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.append(docs.where("id < 20"), "id", "body")
    index.append(docs.where("id >= 20"), "id", "body")
    index.remove(docs.where("id % 4 = 0").select("id"))
    index.remove(docs.where("id % 8 = 0").select("id"))  # gone already
    index.append(docs.where("id = 8"), "id", "body")
    left = [(i, t) for i, t in rows if i % 4 or i == 8]
    fresh = KeywordIndex(spark, str(tmp_path / "fresh"))
    fresh.append(spark.createDataFrame(left, docs.schema), "id", "body")
    for query in ("alpha", "Foo word1", "foo_bar FILLER", "absent"):
        terms = R.query_terms(query)
        want = sorted(map(tuple, fresh.bm25(terms).collect()))
        assert sorted(map(tuple, index.bm25(terms).collect())) == want and (query == "absent") == (want == [])
    index.compact()
    assert sorted(map(tuple, index.bm25(["alpha"]).collect())) == sorted(map(tuple, fresh.bm25(["alpha"]).collect()))
    assert KeywordIndex(spark, str(tmp_path / "none")).bm25(["alpha"]) is None


def test_keyword_queries_read_postings_only(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = R.bm25(docs, "The, WITH")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "In(term" in plan.replace(" ", "") or "PushedFilters" in plan and "term" in plan
    assert "text" not in "".join(x for x in plan.splitlines() if "ReadSchema" in x)


def test_summaries_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n \n"), (4, "one"), (4, "one"), (None, "a b\nb c\n\nzzz")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["summary"], r["n_lines"]) for r in T.gist(docs, 2).collect()) == [(0, "a b\nb c", 2), (4, "one", 1), (4, "one", 1)]


def test_pii_spans_by_place(spark):
    text = "mail a@b.org or 555-123-4567, ssn 123-45-6789 at 10.0.0.1, card 4111 1111 1111 1111"
    rows = T.pii_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r["kind"], r["value"]) for r in rows] == [("email", "a@b.org"), ("phone", "555-123-4567"), ("ssn", "123-45-6789"), ("ip", "10.0.0.1"), ("credit_card", "4111 1111 1111 1111")]
    assert all(text[r["span_start"] : r["span_end"]] == r["value"] for r in rows)


def test_templates_mined_with_a_bar(spark):
    lines = [f"job {'ab'[i % 2]} ended on host{i} after {i % 7}s" for i in range(70)] + ["job c ended", "", "other line"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")
    strict = {r["template"]: r["n"] for r in logs.mine_templates(df).collect()}
    assert strict == {"job <*> ended on <*> after <*>": 70, "job c ended": 1, "": 1, "other line": 1}
    loose = {r["template"]: r["n"] for r in logs.mine_templates(df, share=0.4).collect()}
    assert loose["job a ended on <*> after <*>"] == 35 and loose["job b ended on <*> after <*>"] == 35
    for r in logs.templated(df, share=0.4).collect():
        assert len(r["slots"]) == r["template"].count("<*>")
        for s in r["slots"]:
            r = {"template": r["template"].replace("<*>", s, 1), "line": r["line"], "slots": []}
        assert r["template"] == r["line"]
    best = min(logs.tune(df).collect(), key=lambda r: (r["cost"], r["share"]))
    assert best["cost"] == best["templates"] + 0.1 * best["slots"]


def test_chunks_are_coded_against_similar_and_predicted_ones(spark):
    """A near copy in another document is a delta of the original, every token decodes, and the choice is the smallest of its forms."""
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    base = " ".join(word() for _ in range(140))
    edited = base.replace(base.split()[70], "edited", 1)
    follow = " ".join(word() for _ in range(140))
    rows = []
    for d, parts in enumerate([[base, follow], [edited], [base, follow], [base, follow[:400] + follow], ["tiny"], [""]]):
        rows += [(d, i, hashlib.sha256(p.encode()).hexdigest(), p.encode()) for i, p in enumerate(parts)]
    chunks = spark.createDataFrame(rows, "doc_id long, seq int, sha256 string, data binary")
    coded = D.encoded(chunks)
    got = {(x["doc_id"], x["seq"]): x for x in coded.collect()}
    assert got[0, 0]["token"] == "FULL" and got[1, 0]["token"] == "DELTA" and got[1, 0]["deps"] == [got[0, 0]["sha256"]]
    assert got[2, 0]["token"] == got[2, 1]["token"] == got[3, 0]["token"] == "REF" and got[2, 1]["deps"] == [got[0, 1]["sha256"]]
    assert got[3, 1]["token"] in ("DELTA", "PRED_DELTA") and len(got[3, 1]["payload"]) < 200
    assert sorted((x["doc_id"], x["seq"], bytes(x["data"])) for x in D.decoded(coded).collect()) == sorted((d, i, p) for d, i, _, p in rows)


def test_simhash_pairs_are_all_found(spark):
    import random

    r = random.Random(4)
    hashes = [r.getrandbits(64) for _ in range(60)]
    for h in hashes[:40]:
        x = h
        for bit in r.sample(range(64), r.randrange(0, 12)):
            x ^= 1 << bit
        hashes.append(x)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long")
    got = {(x["id_a"], x["id_b"]): x["distance"] for x in D.simhash_pairs(rows).collect()}
    want = {(i, j): d for i in range(100) for j in range(i + 1, 100) if (d := bin(hashes[i] ^ hashes[j]).count("1")) <= 8}
    first = {h: hashes.index(h) for h in hashes}
    assert got == {(i, j): d for (i, j), d in want.items() if d == 0 and first[hashes[j]] == i or d and first[hashes[i]] == i and first[hashes[j]] == j}


def test_cell_index_recall(spark, monkeypatch):
    """Against exact search, of all vectors whose id is divisible by 20; in blocks, too."""
    import numpy as np

    from memquarry.operators import vector_index
    from memquarry.operators.vector_index import CellIndex

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for block in (8192, 50):
        monkeypatch.setattr(vector_index, "BLOCK", block)
        got = {}
        for r in CellIndex(vectors).search(vectors.where("vec_id % 20 = 0"), 10).collect():
            got.setdefault(r["query"], set()).add(r["neighbour"])
        hits = total = 0
        for q in ids[ids % 20 == 0]:
            s = x @ x[np.flatnonzero(ids == q)[0]]
            s[ids == q] = -2
            hits += len({*ids[np.argsort(-s)[:10]].tolist()} & got[q])
            total += 10
        assert hits >= 0.9 * total, hits / total
    empty = vectors.limit(0)
    assert CellIndex(empty).search(empty).collect() == []


def test_spans_keep_any_text(spark):
    rows = [("get a=b", "t 1", "s%20", None, "ok", {"k ey": "a b=c%25\n d", "n": None})]
    spans = spark.createDataFrame(rows, "name string, trace_id string, span_id string, parent_id string, status string, attributes map<string,string>")
    (back,) = store.line_spans(store.span_lines(spans).select("line")).collect()
    assert back["name"] == "get a=b" and back["fields"] == {"trace_id": "t 1", "span_id": "s%20", "parent_id": "", "status": "ok", "k ey": "a b=c%25\n d"}


def test_simhash_nearest_without_pairs(spark):
    """Against brute force over equal, like and far hashes: the nearest, and the nearest root before each, in one block and in several; and hashes of which all pairs lie near, whose number is their square."""
    import random

    r = random.Random(9)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hashes = [r.getrandbits(64) for _ in range(40)]
    for h in hashes[:40] * 3:
        for bit in r.sample(range(64), r.randrange(0, 12)):
            h ^= 1 << bit
        hashes.append(h)
    r.shuffle(hashes)
    apart = lambda i, j: bin(hashes[i] ^ hashes[j]).count("1")
    first = [hashes.index(h) for h in hashes]
    reps = sorted(set(first))
    want = {}
    for i in range(len(hashes)):
        near = [(0, first[i])] if first[i] < i else [(apart(i, j), j) for j in range(len(hashes)) if j != i and (first[j] == j or first[j] == i)]
        if near and min(near)[0] <= 8:
            want[i] = min(near)
    rows = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "doc_id long, simhash long")
    assert {x["id"]: (x["distance"], x["nearest"]) for x in D.simhash_nearest(rows).collect()} == want
    roots = [i for i in reps if not any(apart(i, j) <= 8 for j in reps if j < i)]
    behind = {i: min((apart(i, j), j) for j in roots if j < i) for i in reps if any(apart(i, j) <= 8 for j in roots if j < i)}
    behind |= {i: (0, f) for i, f in enumerate(first) if f < i and f in roots}
    places = rows.select(F.struct(F.lit("x").alias("k"), F.col("doc_id").cast("int").alias("seq")).alias("id"), "simhash")
    assert {x["id"]["seq"]: x["at"]["seq"] for x in D._earlier_roots(places, 8).collect()} == {i: j for i, (d, j) in behind.items() if d <= 8}
    few = rows.where(F.col("doc_id").isin(reps)).withColumnRenamed("doc_id", "id")
    one = {tuple(x) for x in D.nearest_hashes(few, few).collect()}
    assert one == {tuple(x) for x in D.nearest_hashes(few, few, least_tasks=2, block=30).collect()} and len(one) > 50
    dense = spark.range(4000).select(F.col("id").alias("doc_id"), F.shiftleft(F.col("id"), 3).alias("simhash"))
    found = D.simhash_nearest(dense)
    assert found.count() == 4000 and found.where("distance <> 1").count() == 0


def test_cdc_rebuilt_has_every_text(spark, tmp_path):
    """Texts without chunks, too: empty and null ones."""
    import compare
    from memquarry.plans import registry, sequences  # noqa: F401

    folder = str(tmp_path)
    rows = [(1, "a"), (2, ""), (3, None), (4, "é" * 3000 + "x" * 20000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    compare.same(registry.QUERIES["cdc_rebuilt"](spark, folder), compare.tables(folder), registry.ORACLE_SQL["cdc_rebuilt"])


def test_postings_without_a_shuffle(spark):
    """Equal to counting by hand over runs of any size, each sorted by term; null and empty texts have none."""
    from collections import Counter

    from memquarry.operators.keyword_index import postings

    texts = ["b a b", "", None, "é a Z z 1", "the " * 50 + "end"] * 7
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(1)
    want = {(i, t, n, len((x or "").split())) for i, x in enumerate(texts) for t, n in Counter((x or "").lower().split()).items()}
    for size in (1, 40, 1 << 20):
        out = postings(docs, "id", "body", run_size=size)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("coalesce", "")
        got = out.select("id", "term", "tf", "dl").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert [r["term"] for r in got] == sorted(r["term"] for r in got)


def test_equal_lines_are_mined_once(spark):
    """Templates and counts of repeated lines, and a plan that doesn't read the lines themselves again."""
    lines = spark.createDataFrame([(x,) for x in ["job a ok"] * 5 + ["job b ok"] * 3 + ["job b ok  "] + ["other"] * 2 + [None]], "line string")
    mined = logs.mine_templates(lines)
    assert {r["template"]: r["n"] for r in mined.where("template <> ''").collect()} == {"job <*> ok": 9, "other": 2}
    assert {r["template"]: r["n"] for r in logs.mine_templates(lines, share=0.5).where("template <> ''").collect()} == {"job a ok": 5, "job <*> ok": 4, "other": 2}
    assert "LogicalRDD" not in mined._jdf.queryExecution().optimizedPlan().toString()


def test_motifs_of_sequences_in_memory(spark):
    """By brute force, with sequences over several batches, null keys, null events and names that hold the separator; only events are shuffled."""
    import random

    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, None]), i, r.choice("ab")) for i in range(400)] + [(9, i, r.choice(["a", "a>b", "b", None])) for i in range(400, 450)]
    events = spark.createDataFrame(rows, "u long, at long, e string")
    want: dict = {}
    for u in (1, 2, 3, None, 9):
        seq = [e for k, _, e in rows if k == u]
        for i in range(len(seq)):
            ahead = [e for e in seq[i : i + 10] if e is not None]
            for n in range(3, len(ahead) + 1):
                k, first = want.get((u, ">".join(ahead[:n]), n), (0, i + 1))
                want[u, ">".join(ahead[:n]), n] = (k + 1, first)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = S.motifs(events, "u", ["at"], "e")
        got = {(x["u"], x["motif"], x["n"]): (x["occurrences"], x["first_start"]) for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {m: v for m, v in want.items() if v[0] > 1}
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2 and "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_cooccurrence_sums_shared_pairs_only(spark):
    """Chunks of one set, of several, repeated ones and copies of a set, by counting places."""
    import random
    from collections import Counter

    r = random.Random(8)
    docs = [[r.choice("abcdefgh") if r.random() < 0.6 else f"own{d}{r.randrange(3)}" for _ in range(r.randrange(1, 9))] for d in range(40)]
    docs += docs[:5]
    rows = spark.createDataFrame([(d, p, c) for d, cs in enumerate(docs) for p, c in enumerate(cs)], "doc_id long, pos int, chunk string")
    want = Counter((a, b) for cs in docs for i, a in enumerate(cs) for j, b in enumerate(cs) if i != j)
    got = D.cooccurrence(rows).collect()
    assert len(got) == len(want) and {(x["a"], x["b"]): x["cnt"] for x in got} == want
    full = {tuple(x[c] for c in ("a", "b", "cnt", "rank")) for k in (1, 3) for x in D.predicted(D.cooccurrence(rows), k).collect()}
    some = {tuple(x[c] for c in ("a", "b", "cnt", "rank")) for k in (1, 3) for x in D.predicted_chunks(rows, k).collect()}
    assert some == full and len(some) > 50
    for a in {a for a, _ in want}:
        best = sorted(((-n, b) for (x, b), n in want.items() if x == a))[:3]
        assert {(a, b, -n, i + 1) for i, (n, b) in enumerate(best)} <= some
