"""The service surface end to end, and Bloom filters."""

import json

from pyspark.sql import functions as F

from memquarry.engine import Engine
from memquarry.functions import bloom


def test_memory(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.status().first().asDict() == {"chunks": 0, "entries": 0, "skills": 0, "vectors": 0}
    assert e.ingest_text("the harbour lies below the old fort", "a", "user") == 1
    assert e.ingest_text("the harbour lies below the old fort", "a", "user") == 0
    e.ingest_text("bread needs flour, water, salt and time", "b", "assistant")
    hit = e.search("harbour fort", 5).orderBy("score", ascending=False).first()
    assert hit["content"].startswith("the harbour") and hit["origin"] == "keyword+vector"
    assert e.search("flour", 5, keyword_only=True).count() == 1
    assert e.recall("harbour", 3).count() >= 1
    assert "<memory" in e.augment("bread flour", 2).first()["context"]
    (tmp_path / "in").mkdir()
    rows = [{"type": "user", "message": {"content": "tell me about the northern lights"}}, {"type": "assistant", "message": {"content": "they are seen near the poles in winter"}}]
    (tmp_path / "in/s9.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert {r["role"]: r["n"] for r in e.ingest_sessions(str(tmp_path / "in")).collect()} == {"user": 1, "assistant": 1}
    assert [tuple(r) for r in e.sessions().collect()] == [("s9", 2)]
    (tmp_path / "note.txt").write_text("a note on tides\n" * 5)
    assert e.ingest_file(str(tmp_path / "note.txt")) == 1
    assert e.dedup_stats().first()["total_refs"] > e.dedup_stats().first()["unique_chunks"]
    assert e.status().first()["chunks"] == 5 == e.status().first()["vectors"]
    assert e.audit_log().count() >= 6


def test_bank(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.add_entry("", "x", [], []) == (None, ["empty title", "no evidence"])
    old, against = e.add_entry("tides follow the moon", "high water twice a day", ["sea"], ["e1"])
    assert old and against == []
    new = e.supersede(old, "tides follow moon and sun", "spring tides are higher", ["sea"], ["e2"])
    assert [r["id"] for r in e.entries().collect()] == [new]
    assert {r["node"]: r["last"] for r in e.chain().collect()} == {old: new, new: new}
    e.retract(new)
    assert e.entries().count() == 0
    assert e.add_evidence("a claim", ["s"], 1.5) is None and e.add_evidence("a claim", ["s"], 0.5)
    assert e.add_skill("sail", "how to sail", "hoist", ["sea"]) == 1 and e.add_skill("sail", "how to sail", "hoist and trim", ["sea"]) == 2
    assert e.skills().first()["procedure"] == "hoist and trim" and e.search_skills("trim").count() == 1
    e.carry_over("s", "first", ["f1"], ["q1"], [])
    e.carry_over("s", "second", ["f1", "f2"], ["q2"], ["q1"])
    assert e.carried_over("s").first()["prompt"] == "# Carried over (2)\nsecond\n## Facts\n- f1\n- f2\n## Open questions\n- q2"


def test_reasoning_commits_and_the_semantic_gate(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.last_commit().count() == 0
    e.commit("v1", 3, 0.95, "first")
    e.commit("v1", 0, 0.7, "second")
    e.store.compact("commits")
    e.store.compact("sessions")  # nothing there yet
    last = e.last_commit().first()
    assert (last["text"], last["used_tier"], len(last["text_fingerprint"])) == ("second", 0, 10)
    e.ingest_text("tides follow the moon and the sun", "a", "user")
    old, _ = e.add_entry("tides follow the moon", "tides follow the moon and sun", [], ["e1"])
    # the chunk is near by its vector; its first words find the entry
    assert [r["id"] for r in e._overlapping("tides follow the moon and the sun").collect()] == [old]
    assert e._overlapping("nothing alike at all").collect() == []
    out = e.reason("tides", [{"query": "tides moon", "output": "read", "new_facts": ["f"], "write_title": "spring tides", "write_content": "are higher", "evidence_ids": ["e2"]}, {"query": "moon", "output": "no", "write_title": "x", "write_content": "y"}])
    assert len(out["written"]) == 1 and out["refused"][0][0] == "x" and out["contexts"][0].count() >= 1
    assert "- f" in e.carried_over(out["session"]).first()["prompt"]
    assert "Found" in e.carried_over(e.reason("moon")["session"]).first()["prompt"]


def test_blooms(spark):
    rows = spark.createDataFrame([(g, f"tok{g}-{i}") for g in range(3) for i in range(100)], "g int, token string")
    filters = bloom.blooms(rows, "g").cache()
    hits = filters.join(rows, "g").select(bloom.might_hold(F.col("bloom"), F.col("token")).alias("h"))
    assert hits.where("NOT h").count() == 0
    rate = bloom.false_positive_rate(filters, spark.createDataFrame([(f"new{i}",) for i in range(500)], "token string")).first()["rate"]
    assert rate < 0.01


def test_false_positives_of_many_filters_and_tokens(spark):
    """Every token against every filter, as bits: the rate is that of single tests, over more filters than a row of bits holds; none where there is nothing to test; and a cross join isn't in the plan."""
    rows = spark.range(3000).select((F.col("id") % 150).alias("g"), F.concat(F.lit("tok"), "id").alias("token"))
    filters = bloom.blooms(rows, "g", bits=256)
    unseen = spark.range(700).select(F.concat(F.lit("new"), "id").alias("token"))
    want = filters.crossJoin(unseen).agg(F.avg(bloom.might_hold(F.col("bloom"), F.col("token"), 256).cast("double")).alias("rate")).first()["rate"]
    got = bloom.false_positive_rate(filters, unseen, bits=256)
    assert got.first()["rate"] == want > 0
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert bloom.false_positive_rate(filters, unseen.limit(0), bits=256).first()["rate"] is None
