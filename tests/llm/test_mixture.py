import itertools
import random
import struct

import numpy as np
import xxhash

from memquarry.llm import mixture, token_counts


def best_sum(lengths, counts, budget):
    return max(s for take in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(t * n for t, n in zip(take, lengths))) <= budget)


def test_fill_is_the_best_subset_sum():
    r = random.Random(5)
    for _ in range(200):
        lengths = np.array(r.sample(range(1, 40), 4))
        counts = np.array([r.randrange(4) for _ in lengths])
        budget = r.randrange(0, 150)
        take = mixture.fill(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == best_sum(lengths, counts, budget)


def test_plan_stays_within_counts_and_budget():
    r = np.random.default_rng(2)
    for _ in range(50):
        lengths, counts = r.choice(5000, 60, replace=False), r.integers(0, 200, 60)
        budget = int((lengths * counts).sum() * r.random())
        take = mixture.plan(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and budget - 2 <= (take * lengths).sum() <= max(budget, 0) + 0


def test_budgets():
    assert mixture.budgets({"a": 100, "b": 100}, {"a": 3, "b": 1}, None, 0.7) == {"a": 100, "b": 33}
    assert mixture.budgets({"a": 100, "b": 50, "c": 9}, {"a": 1, "b": 1}, 60, 0.7) == {"a": 30, "b": 30, "c": 0}
    assert mixture.budgets({}, None, None, 0.7) == {}


def test_selection_meets_the_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = token_counts.encoding(token_counts.RANKS)
    size = {r["doc_id"]: (r["source"], len(known.encode_ordinary(r["text"]))) for r in docs.collect()}
    chosen = mixture.select(docs, weights={"src0": 1, "src1": 2}, total=60_000).collect()
    got = {}
    for r in chosen:
        assert size[r["doc_id"]] == (r["source"], r["n_tokens"])
        got[r["source"]] = got.get(r["source"], 0) + r["n_tokens"]
    have = {s: sum(n for t, n in size.values() if t == s) for s in ("src0", "src1")}
    want = {"src0": min(20_000, have["src0"]), "src1": min(40_000, have["src1"])}
    assert set(got) == set(want) and all(0.999 * want[s] <= got[s] <= want[s] for s in want)
    again = mixture.select(docs.repartition(7), weights={"src0": 1, "src1": 2}, total=60_000)
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in chosen}


def test_query_against_brute_force(spark, data):
    """The plan of every source, made from all lengths in plain Python, has the query's count of each length."""
    from memquarry.llm.queries import op2_mixture

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    known = token_counts.encoding(token_counts.RANKS)
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append(len(known.encode_ordinary(r["text"])))
    goal = mixture.budgets({s: sum(v) for s, v in by.items()}, None, None, mixture.ALPHA)
    want = {}
    for s, v in by.items():
        lengths, counts = np.unique(v, return_counts=True)
        want |= {(s, int(n)): int(k) for n, k in zip(lengths, mixture.plan(lengths, counts, goal[s])) if k}
    got = {}
    for r in op2_mixture(spark, data).collect():
        got[r["source"], r["n_tokens"]] = got.get((r["source"], r["n_tokens"]), 0) + 1
    assert got == want


def spark_hash(doc_id, seed):
    """Spark's xxhash64 of an id and a seed, by the library."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42))
    return h - (1 << 64) if h >> 63 else h


def test_budgets_sums_and_seeded_picks_by_brute_force(spark):
    """Without the module's own plan: budgets by the formula, each source's sum the largest that any choice of its documents reaches within its budget, and of each length the documents that come first by hash."""
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    known = token_counts.encoding(token_counts.RANKS)
    size = {d: (s, len(known.encode_ordinary(t))) for d, s, t in docs}
    total = {}
    for s, n in size.values():
        total[s] = total.get(s, 0) + n
    weight = {s: t**0.7 for s, t in total.items()}
    whole = min(total[s] / weight[s] for s in total)
    picked = mixture.select(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    chosen = {r["doc_id"] for r in picked}
    assert len(chosen) == len(picked) and all((r["source"], r["n_tokens"]) == size[r["doc_id"]] for r in picked)
    for s in total:
        budget = min(total[s], int(whole * weight[s] + 1e-6))
        reach = 1
        for d, (t, n) in size.items():
            if t == s:
                reach |= reach << n
        best = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
        assert sum(size[d][1] for d in chosen if size[d][0] == s) == best
        for n in {n for t, n in size.values() if t == s}:
            order = sorted((spark_hash(d, mixture.SEED), d) for d, x in size.items() if x == (s, n))
            k = sum(d in chosen for _, d in order)
            assert {d for _, d in order[:k]} <= chosen


def test_one_length_ranked_in_parts(spark):
    """Ten thousand documents of one source and length, and one of another, ranked about ten at a time: the ones that plain sorting takes."""
    counted = spark.createDataFrame([(i, None if i % 2 else "s", 5) for i in range(10_000)] + [(-1, "s", 6)], "doc_id long, source string, n_tokens long")
    quota = spark.createDataFrame([("s", 5, 1234), (None, 5, 77), ("s", 6, 1)], "source string, n_tokens long, take long")
    for most in (10, 1000, 10**9):
        got = {r["doc_id"] for r in mixture.taken(counted, quota, 17, most).collect()}
        first = lambda ids, k: {d for _, d in sorted((spark_hash(d, 17), d) for d in ids)[:k]}
        assert got == first(range(0, 10_000, 2), 1234) | first(range(1, 10_000, 2), 77) | {-1}


def test_odd_tables(odd, table):
    rows = mixture.select(odd).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and None not in ids
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} <= {0}
    assert mixture.select(table([])).collect() == []
    assert mixture.mixed(table([])).count() == 0
    out = mixture.mixed(odd)
    assert out.columns == odd.columns and set(r["doc_id"] for r in out.collect()) == set(ids)
    nulls = table([(1, "a b", "en", None), (2, "a b", "en", None)])
    assert len(mixture.select(nulls, weights={None: 1}).collect()) == 2
    assert len(mixture.select(nulls, weights={None: 1}, total=2).collect()) == 1
