"""The service surface as one class over the store: ingest, search, recall, augment, the knowledge bank, sessions, status, similarity, reports.

Every method that reads returns a DataFrame; those that write append rows and an audit row. Current states (of entries, skills, sessions) are the latest row of each id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.functions.text import fingerprint
from memquarry.operators import bank, dedup, retrieval, sequence
from memquarry.operators.keyword_index import KeywordIndex
from memquarry.sources import sessions
from memquarry.sources.store import Store, embedder, missing_embeddings, with_embeddings


class Engine:
    def __init__(self, spark: SparkSession, root: str, dims: int = 64, embed=None, model: str = "hashed-words"):
        self.spark, self.store, self.dims, self.model = spark, Store(spark, root), dims, model
        self.embed = embed or embedder(dims)
        self.words = KeywordIndex(spark, f"{root}/chunk_words")

    # ---- ingest

    def _save_chunks(self, rows: DataFrame) -> int:
        """Appends chunks whose id isn't there; ids are digests, so the same input again adds nothing."""
        new = rows.dropDuplicates(["id"]).join(self.store.table("chunks").select("id"), "id", "left_anti").withColumn("created_at", F.current_timestamp()).cache()
        n = new.count()
        if n:
            self.index(new)  # first: writing chunks makes Spark drop what is cached over them
            self.words.append(new.select("id", "content"), "id", "content")
            self.store.append("chunks", new)
        new.unpersist()
        return n

    def index(self, chunks: DataFrame) -> None:
        """Embeds what the cache lacks for this model."""
        missing = missing_embeddings(chunks, self.store.table("embedding_cache"), self.model)
        self.store.append("embedding_cache", missing.withColumn("embedding", self.embed("content")))

    def ingest_text(self, text: str, source_id: str = "", role: str = "") -> int:
        docs = self.spark.createDataFrame([(source_id, text)], "source string, text string")
        rows = sessions.chunked(docs, "source")
        n = self._save_chunks(rows.select(F.sha2(F.concat_ws("|", "source", F.col("idx").cast("string"), "content"), 256).alias("id"), F.col("source").alias("source_id"), "content", F.lit(role or None).cast("string").alias("role"), "idx"))
        self.store.audit("ingest", "text", source_id, f"{n} chunks")
        return n

    def ingest_file(self, path: str) -> int:
        raw = self.spark.read.format("binaryFile").load(path)
        named = raw.select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.lit("text/plain").alias("mime_type"), F.current_timestamp().alias("created_at"), F.col("content").cast("string").alias("text"))
        self.store.append("files", named)
        rows = sessions.chunked(named, "content_hash")
        n = self._save_chunks(rows.select(F.sha2(F.concat_ws("|", "content_hash", F.col("idx").cast("string"), "content"), 256).alias("id"), F.col("content_hash").alias("source_id"), "content", "idx"))
        self.store.audit("ingest", "file", path, f"{n} chunks")
        return n

    def ingest_sessions(self, path: str) -> DataFrame:
        """Stores users' and assistants' messages of session files; gives the count of each role that was read."""
        parsed = sessions.read_sessions(self.spark, path)
        self._save_chunks(sessions.stored(parsed).withColumn("source_id", F.col("session_id")))
        self.store.audit("ingest", "sessions", path)
        return parsed.groupBy("role").agg(F.count(F.lit(1)).alias("n"))

    # ---- retrieval

    def chunks(self) -> DataFrame:
        return self.store.table("chunks")

    def _keyword(self, query: str, k: int) -> DataFrame:
        found = retrieval.search_all(retrieval.bm25(self.chunks(), query, "id", "content", index=self.words), self._bank_scores(query), k)
        return found

    def _bank_scores(self, query: str) -> DataFrame:
        text = self.bank().withColumn("__text", F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
        return retrieval.bm25(text, query, "id", "__text", F.col("status") == "active")

    def _texts(self) -> DataFrame:
        return self.chunks().select("id", "content", "role", "session_id").unionByName(self.bank().select("id", "content", F.lit(None).cast("string").alias("role"), "session_id"))

    def search(self, query: str, k: int = 20, keyword_only: bool = False) -> DataFrame:
        """id, score, origin, content, role, session_id: fused, or keywords alone."""
        words = self._keyword(query, 3 * k)
        if keyword_only:
            found = words.orderBy(F.desc("score"), "id").limit(k)
        else:
            asked = self.spark.createDataFrame([(query,)], "content string").select(self.embed("content").alias("embedding"))
            held = with_embeddings(self.chunks().select("id", "content"), self.store.table("embedding_cache"), self.model).where("embedding IS NOT NULL")
            found = retrieval.fuse(retrieval.ranked(words.select("id", "score"), 3 * k, "id"), retrieval.ranked(retrieval.vector_scores(held, asked, "id"), 3 * k, "id"), k, "id")
        self.store.audit("search", "memory", "", query)
        return self._texts().join(F.broadcast(found), "id")  # at most k rows

    def recall(self, query: str, k: int = 10, session: str = "") -> DataFrame:
        return retrieval.recall(self.search(query, 2 * k), k, session)

    def augment(self, query: str, k: int = 5, roles: tuple = ("user", "assistant"), min_score: float = 0.005) -> DataFrame:
        return retrieval.augment_text(retrieval.augment(self.search(query, 10 * k), k, list(roles), min_score))

    # ---- knowledge

    def bank(self) -> DataFrame:
        rows = self.store.table("reasoning_bank")
        last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "created_at").alias("r"))
        return last.select("id", "r.*")

    def add_entry(self, title: str, content: str, tags: list[str], evidence: list[str], session: str = "") -> tuple[str | None, list[str]]:
        """The new entry's id and what contradicts it; None and the issues where the gate refuses."""
        row = self.spark.createDataFrame([(uuid.uuid4().hex, title, content, tags, evidence, "active", session)], "id string, title string, content string, tags array<string>, evidence_ids array<string>, status string, session_id string")
        found = row.select(bank.issues(F.col("title"), F.col("content"), F.col("evidence_ids")).alias("i"), "id").first()
        if found["i"]:
            self.store.audit("write", "reasoning", found["id"], "; ".join(found["i"]), "refused")
            return None, found["i"]
        against = [r["id"] for r in bank.contradictions(self.bank(), title).collect()]
        against += sorted({r["id"] for r in self._overlapping(f"{title}. {content}").collect()} - set(against))
        new = found["id"]
        self.store.append("reasoning_bank", self.spark.createDataFrame([(new, title, content, tags, evidence, "active", session)], row.schema).withColumn("created_at", F.current_timestamp()))
        self.store.audit("write", "reasoning", new, f"{len(against)} contradictions")
        return new, against

    def _overlapping(self, text: str) -> DataFrame:
        """Active entries near a text by its vector."""
        asked = self.spark.createDataFrame([(text,)], "content string").select(self.embed("content").alias("embedding"))
        chunks = self.chunks().select("id", "content")
        held = with_embeddings(chunks, self.store.table("embedding_cache"), self.model).where("embedding IS NOT NULL").select("id", "embedding")
        return bank.semantic_contradictions(self.bank(), chunks, held, asked)

    def reason(self, task: str, steps: list[dict] | None = None) -> dict:
        """Runs the steps of a task in a session of its own: each searches by its query, carries its facts and questions over, and writes an entry where it has a title and content and the gate lets it pass.

        A step has query, output and, where it wants, new_facts, resolved_questions, new_questions, write_title, write_content, write_tags, evidence_ids. Without steps the task is searched for. Gives session, contexts (a DataFrame of
        each step's results), written and refused.
        """
        session = uuid.uuid4().hex
        self.start_session(session)
        self.carry_over(session, f"Task: {task}", [], [task], [])
        out = {"session": session, "contexts": [], "written": [], "refused": []}
        for n, step in enumerate([{"query": task}] if not steps else steps):
            found = self.search(step.get("query", ""), 10)
            out["contexts"].append(found)
            if not steps:
                k = found.count()
                step = {"output": f"Retrieved {k} relevant entries.", "new_facts": [f"Found {k} results for: {task}"]}
            self.carry_over(session, f"Step {n}: {step.get('output', '')[:200]}", step.get("new_facts") or [], step.get("new_questions") or [], step.get("resolved_questions") or [])
            if step.get("write_title") and step.get("write_content"):
                entry, issues = self.add_entry(step["write_title"], step["write_content"], step.get("write_tags") or [], step.get("evidence_ids") or [], session)
                out["written" if entry else "refused"].append(entry or (step["write_title"], issues))
        self.end_session(session)
        return out

    def commit(self, packet_version: str, used_tier: int, confidence: float, text: str) -> None:
        """Appends a decoded memory that was accepted, with its fingerprint."""
        row = self.spark.createDataFrame([(packet_version, used_tier, float(confidence), text)], "packet_version string, used_tier int, confidence double, text string")
        self.store.append("commits", row.withColumn("text_fingerprint", fingerprint(F.col("text"))).withColumn("created_at", F.current_timestamp()))

    def last_commit(self) -> DataFrame:
        """The latest commit's row; none before the first."""
        rows = self.store.table("commits")
        return rows.orderBy(F.desc("created_at")).limit(1)

    def _restate(self, entry: str, change) -> None:
        row = change(self.bank().where(F.col("id") == entry)).withColumn("created_at", F.current_timestamp())
        self.store.append("reasoning_bank", row)

    def supersede(self, old: str, title: str, content: str, tags: list[str], evidence: list[str]) -> str | None:
        new, _ = self.add_entry(title, content, tags, evidence)
        if new:
            self._restate(old, lambda r: bank.superseded(r, old, new))
            self.store.audit("supersede", "reasoning", old, new)
        return new

    def retract(self, entry: str) -> None:
        self._restate(entry, lambda r: bank.retracted(r, entry))
        self.store.audit("retract", "reasoning", entry)

    def entries(self, k: int = 100) -> DataFrame:
        return bank.newest(self.bank().where("status = 'active'"), k)

    def chain(self) -> DataFrame:
        return bank.chains(self.bank(), "id", "superseded_by")

    def add_evidence(self, claim: str, sources: list[str], confidence: float, reasoning: str = "") -> str | None:
        row = self.spark.createDataFrame([(uuid.uuid4().hex, claim, sources, float(confidence), reasoning)], "id string, claim string, sources array<string>, confidence double, reasoning string")
        found = row.select("id", bank.evidence_ok(F.col("claim"), F.col("sources"), F.col("confidence")).alias("ok")).first()
        if not found["ok"]:
            return None
        self.store.append("evidence_packs", row.withColumn("created_at", F.current_timestamp()))
        self.store.audit("write", "evidence", found["id"])
        return found["id"]

    def add_skill(self, name: str, description: str, procedure: str, tags: list[str]) -> int:
        """The version of the skill that was written."""
        last = self.skills().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
        row = [(uuid.uuid4().hex, name, description, procedure, tags, last + 1)]
        self.store.append("skill_capsules", self.spark.createDataFrame(row, "id string, name string, description string, procedure string, tags array<string>, version int").withColumn("created_at", F.current_timestamp()))
        return last + 1

    def skills(self) -> DataFrame:
        return bank.next_version(self.store.table("skill_capsules"))

    def search_skills(self, query: str, k: int = 10) -> DataFrame:
        text = self.skills().withColumn("__text", F.concat_ws(" ", "name", "description", "procedure", F.array_join("tags", " ")))
        return text.drop("__text").join(F.broadcast(retrieval.top(retrieval.bm25(text, query, "id", "__text"), k, "id")), "id")

    # ---- sessions, carry-over, reports

    def start_session(self, session: str) -> None:
        self.store.append("sessions", self.spark.createDataFrame([(session,)], "id string").withColumn("started_at", F.current_timestamp()))

    def end_session(self, session: str) -> None:
        self.store.append("sessions", self.spark.createDataFrame([(session,)], "id string").withColumn("ended_at", F.current_timestamp()))

    def sessions(self, k: int = 100) -> DataFrame:
        """session_id and chunks, most first."""
        return self.chunks().where("session_id IS NOT NULL").groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "session_id").limit(k)

    def carry_over(self, session: str, summary: str, facts: list[str], questions: list[str], resolved: list[str]) -> None:
        last = self.store.table("cos").where(F.col("session_id") == session).orderBy(F.desc("sequence")).limit(1)
        old = last.select("sequence", "key_facts", "open_questions").first() or (0, [], [])
        kept = [*dict.fromkeys([*(old[1] or []), *facts])]
        asked = [*dict.fromkeys([*(q for q in old[2] or [] if q not in resolved), *questions])]
        self.store.append("cos", self.spark.createDataFrame([(session, old[0] + 1, summary, kept, asked)], "session_id string, sequence long, summary string, key_facts array<string>, open_questions array<string>").withColumn("created_at", F.current_timestamp()))

    def carried_over(self, session: str) -> DataFrame:
        rows = self.store.table("cos").where(F.col("session_id") == session)
        return rows.orderBy(F.desc("sequence")).limit(1).select(bank.rendered_summary(F.col("sequence"), F.col("summary"), F.col("key_facts"), F.col("open_questions")).alias("prompt"))

    def status(self) -> DataFrame:
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return one(self.chunks(), "chunks").crossJoin(one(self.bank().where("status = 'active'"), "entries")).crossJoin(one(self.skills(), "skills")).crossJoin(one(self.store.table("embedding_cache").where(F.col("model") == self.model), "vectors"))

    def audit_log(self, k: int = 100) -> DataFrame:
        return self.store.newest("audit_log", k)

    def dedup_stats(self) -> DataFrame:
        return dedup.store_stats(dedup.line_chunks(self.chunks().select("id", "content"), "id", "content"))

    def compress_prompt(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        return dedup.compacted(docs, dedup.line_chunks(docs, key), key=key)

    def expand_prompt(self, compact: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        return dedup.expanded(compact, dedup.line_chunks(docs, key), key)

    def similar(self, chunk: str, least: float = 0.3) -> DataFrame:
        return dedup.similar_to(dedup.line_chunks(self.chunks().select("id", "content"), "id", "content"), "id", "chunk", chunk, least)

    def compare(self, a: str, b: str) -> float:
        sets = {r["id"]: set(r["s"]) for r in dedup.line_chunks(self.chunks().where(F.col("id").isin(a, b)).select("id", "content"), "id", "content").groupBy("id").agg(F.collect_set("chunk").alias("s")).collect()}
        x, y = sets.get(a, set()), sets.get(b, set())
        return len(x & y) / len(x | y) if x | y else 0.0

    def motifs(self, events: DataFrame, by: str, order: list[str], event: str) -> DataFrame:
        return sequence.motifs(events, by, order, event).orderBy(F.desc("weight"), "motif")

    def anomaly_report(self, rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
        """The drift of each label with its number of alerts."""
        alerts = sequence.rolling_z(rows, by, order, value).where("severity IS NOT NULL").groupBy(by).agg(F.count(F.lit(1)).alias("alerts"))
        return sequence.drift(rows, by, order, value).join(alerts, by, "left").fillna(0, ["alerts"])
