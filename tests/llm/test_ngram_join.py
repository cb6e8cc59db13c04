import itertools
import random
import re

import numpy as np
import pytest

import compare
from memquarry.llm import common
from memquarry.llm import ngram_join as J
from memquarry.llm import set_join as S
from memquarry.llm.queries import ORACLE_SQL, op8_ngram_jaccard


def grams(text, n=3):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold=0.5, n=3):
    best = {}
    for (a, x), (b, y) in itertools.combinations([(i, grams(t, n)) for i, t in rows if i is not None], 2):
        if a != b and x and y and (s := len(x & y) / len(x | y)) >= threshold:
            k = (min(a, b), max(a, b))
            best[k] = max(best.get(k, 0), round(s, 6))
    return best


def pairs(df):
    return {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in df.collect()}


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def family(r, copies, n=80):
    base = words(r, n)
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(n)] = f"e{r.randrange(999)}"
        yield " ".join(w)


def test_bound_never_loses_a_pair():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = np.unique(r.integers(0, 1 << 48, r.integers(1, 400), dtype=np.uint64))
        sets += [base, np.unique(np.concatenate((base[r.random(len(base)) < 0.9], r.integers(0, 1 << 48, 5, dtype=np.uint64))))]
    points, sizes = S.points_of(sets), np.array([len(s) for s in sets])
    for right in (None, np.arange(60, 120)):
        left = np.arange(120) if right is None else np.arange(60)
        i, j = S.candidates(points, sizes, left, right, 0.5)
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        assert len(got) == len(i)
        for a in left:
            for b in left if right is None else right:
                common_ = S.overlap(sets[a], sets[b])
                if a < b and common_ >= 0.5 * (sizes[a] + sizes[b] - common_):
                    assert (a, b) in got


def test_word_hashes_are_equal_where_words_are():
    r = random.Random(5)
    letters = "abcXYZÄßéİΣσς日本９٤_ ,.\n\t-'🙂"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(400)] + [None, "", "x" * 5000, "x" * 4999 + "y"]
    h, counts = common.word_hashes(texts)
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_pack_and_order():
    r = np.random.default_rng(3)
    for top in (1, 200, 1 << 20, 1 << 50, 1 << 63):
        a, b = r.integers(0, top, 1000, dtype=np.uint64), r.integers(0, 7, 1000, dtype=np.uint64)
        x, y = common.unpack(common.pack(a, b))
        assert (x == a).all() and (y == b).all() and (a[common.order_of(a)] == np.sort(a)).all()
        assert (b[common.order_of(b)] == np.sort(b)).all()
    assert common.order_of(np.array([5], np.uint64)).tolist() == [0] and [len(c) for c in common.unpack(common.pack(np.empty(0, np.uint64)))] == [0]
    high = np.array([(k << 40) | j for k in (3, 1, 1 << 23, 1) for j in (9, 2)], np.uint64).repeat(50_000)
    assert (high[common.order_of(high)] == np.sort(high)).all()


def classes(rows, threshold=0.5, n=3):
    """doc_id -> (class_id, n_links), of ids that have one text each."""
    found = brute(rows, threshold, n)
    root, k = {i: i for i, _ in rows if i is not None}, {i: 0 for i, _ in rows if i is not None}
    for a, b in found:
        k[a] += 1
        k[b] += 1
    for _ in root:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a, b in found):
            break
    return {i: (root[i], k[i]) for i in root}


def found_classes(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_same_as_sql(spark, data):
    compare.same(op8_ngram_jaccard(spark, data), compare.tables(data), ORACLE_SQL["op8_ngram_jaccard"])


def test_groups_of_near_copies_over_several_blocks(spark, table, monkeypatch):
    r = random.Random(7)
    rows = [(i, t) for i, t in enumerate([*family(r, 60), *family(r, 2), *(" ".join(words(r, 50)) for _ in range(40)), "a shared head " * 20])]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:30])]
    # blocks and parties are cut by the driver's plan, small ranges of items by the workers' functions
    for block, visitors, hot in ((256, 1024, 20_000), (8, 16, 20_000), (3, 1, 2)):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "VISITORS", visitors)
        assert pairs(J.ngram_pairs(table(rows))) == brute(rows)
    assert found_classes(J.ngram_classes(table(rows))) == classes(rows)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    assert {x["doc_id"] for x in J.one_of_each_group(table(rows)).collect()} == {i for i, (c, _) in classes(rows).items() if c == i}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_exact_beside_the_threshold(spark, table, threshold):
    """Pairs whose similarity lies closely on either side of the bar, of texts of very different lengths, too, that share grams with many others."""
    r = random.Random(int(100 * threshold))
    passage = words(r, 30)
    rows = []
    for k in range(350):
        n = r.choice([5, 12, 40, 120])
        w = words(r, n)
        keep = threshold + r.uniform(-0.08, 0.12)
        cut = max(1, round(n * 2 * keep / (1 + keep)))
        v = w[:cut] + words(r, n - cut) if r.random() < 0.6 else w[: max(1, round(n * keep))]
        if r.random() < 0.4:
            w, v = w + passage, passage + v
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    want = brute(rows, threshold)
    assert len(want) > 100 and pairs(J.ngram_pairs(table(rows), threshold=threshold)) == want
    assert found_classes(J.ngram_classes(table(rows), threshold=threshold)) == classes(rows, threshold)


def test_a_passage_in_a_third_of_all_rows(table):
    r = random.Random(11)
    passage = words(r, 20)
    rows = [(i, " ".join([*words(r, 6), *passage, *words(r, 6 + i % 5)]) if i % 3 else " ".join(words(r, 30))) for i in range(300)]
    assert pairs(J.ngram_pairs(table(rows))) == brute(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (4, 3), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, **{k: 20 for k in range(20, 26)}}
    assert J.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group(spark, table):
    r = random.Random(3)
    a, b = list(family(r, 5)), list(family(r, 3))
    clean = [" ".join(words(r, 60)) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate([*clean, *a, *b])] + [(100, a[0]), (101, a[0]), (102, None), (103, "")]
    out = J.one_of_each_group(table(rows))
    assert sorted(x["doc_id"] for x in out.collect()) == [*range(10), 10, 15, 102, 103] and out.columns == table(rows).columns


def test_odd_tables(odd, table):
    from odd import ODD

    assert pairs(J.ngram_pairs(odd)) == brute([r[:2] for r in ODD])
    assert found_classes(J.ngram_classes(odd)) == {i: (i, 0) for i in range(1, 10)}
    assert found_classes(J.ngram_classes(table([]))) == {} and found_classes(J.ngram_classes(table([(None, "a b c")]))) == {}
    several = [(5, "a b c d"), (5, "e f g h"), (7, "e f g h"), (9, "a b c d"), (9, "a b c d"), (3, "A, b! c d"), (4, None), (6, "")]
    assert found_classes(J.ngram_classes(table(several))) == {5: (3, 3), 7: (3, 1), 9: (3, 2), 3: (3, 2), 4: (4, 0), 6: (6, 0)}
    assert pairs(J.ngram_pairs(table([(5, "a b c d"), (5, "e f g h"), (7, "e f g h"), (9, "a b c d"), (3, "A, b! c d")]))) == {(5, 7): 1.0, (5, 9): 1.0, (3, 5): 1.0, (3, 9): 1.0}
    assert J.ngram_pairs(table([])).collect() == [] and J.one_of_each_group(table([])).collect() == []
    assert J.one_of_each_group(odd).count() == odd.count()


@pytest.mark.parametrize("n", [1, 5])
def test_other_lengths(table, n):
    rows = [(1, "one two three four five six"), (2, "one two three four five seven"), (3, "one two"), (4, "two one"), (5, "one two")]
    got = pairs(J.ngram_pairs(table(rows), n=n, threshold=0.3))
    assert got == {k: v for k, v in brute(rows, 0.3, n).items()}


def test_items_of_many_leaves_are_met_in_blocks(table, monkeypatch):
    """Short texts that share single grams in many ways, so that items lie in many leaves; the pairs are the same in blocks of any size."""
    r = random.Random(21)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(4, 9)))) for i in range(120)]
    want = brute(rows)
    for hot in (2, 7, 20_000):
        monkeypatch.setattr(S, "HOT", hot)
        assert pairs(J.ngram_pairs(table(rows))) == want
