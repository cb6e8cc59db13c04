import corpus_pipeline as P
from memquarry.llm import langid, ngram_join, piece_codec, pii

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage's decisions against plain Python over what the stage before kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == columns, name
        rows = after.collect()
        old = {r["doc_id"]: r for r in before.collect()}
        ids = {r["doc_id"] for r in rows}
        assert ids <= set(old) and len(ids) == len(rows)
        if name == "language":
            model = langid.fit(before)
            assert ids == {i for i, r in old.items() if langid.similarities(model, r["text"])[2]}
        elif name == "near_duplicates":
            pairs = [(r["doc_a"], r["doc_b"]) for r in ngram_join.ngram_pairs(before).collect()]
            root = {i: i for i in old}
            for _ in old:
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            assert ids == {i for i in old if root[i] == i} and len(ids) < len(old)
        elif name == "personal_data":
            assert ids == set(old) and all(r["text"] == pii.redact(old[r["doc_id"]]["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
        else:
            assert len(ids) >= 0.5 * len(old)
        before = spark.createDataFrame(rows, docs.schema)
    last = P.STAGES[-1][1](spark, before, DATA)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode(last).collect()} == texts
    run = {r["doc_id"]: r["ids"] for r in P.run(spark, DATA).collect()}
    assert run == {r["doc_id"]: r["ids"] for r in last.collect()}


def test_odd_and_empty_tables(odd, table):
    spark = odd.sparkSession
    for rows in (table([]), odd):
        docs = rows
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, DATA)
            assert k == len(P.STAGES) - 1 or docs.schema == rows.schema
        docs.collect()
