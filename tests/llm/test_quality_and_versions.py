import random
import string

import numpy as np
import pytest
import zstandard

import compare
from memquarry.llm import compress_bands as B, license_scan as S, paragraph_sketch as P, repair as R, token_counts as C
from memquarry.llm.queries import ORACLE_SQL, op5_compression, op6_version_differences, op7_repair_shards, op9_license_notices

# ---- compression bands


def test_bands():
    z = zstandard.ZstdCompressor(level=B.LEVEL)
    r = random.Random(1)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(words[: 1 + int(abs(r.gauss(0, 600)))] or words) for _ in range(n))
    noise = lambda n: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    for n in (20, 100, 1000, 5000):
        assert B.rate(prose(n), z)[3] == "keep", n
    for n in (300, 3000, 30_000):
        assert B.rate("again and again. " * (n // 16), z)[3] == "repetitive"
    for n in (2000, 8000, 60_000):
        assert B.rate(noise(n), z)[3] == "incompressible", n
    assert B.rate(prose(3000) + "la " * 8000, z)[3] == "repetitive"
    assert B.rate(None, z) == (None, None, None, "keep") and B.rate("", z)[3] == "keep" and B.rate("Hi.", z)[3] == "keep"


def plain_rating(text, chunk=4096, share=0.25):
    """Ratios and verdict by the definition, with limits written out again."""
    if not text:
        return None, None, None, "keep"
    z = zstandard.ZstdCompressor(level=3)
    limit = {0: (0, 1.5), 32: (0, 1.8), 64: (0.8, 2.2), 128: (0.95, 2.5), 256: (1.1, 2.8), 512: (1.2, 3.2), 1024: (1.33, 3.5), 4096: (1.4, 4.5), 16384: (1.45, 5.5)}
    of = lambda n: limit[max(k for k in limit if k <= n)]
    b = text.encode("utf-8", "replace")
    whole = len(b) / len(z.compress(b))
    parts = [b[i : i + chunk] for i in range(0, len(b), chunk)]
    ratios = [len(p) / len(z.compress(p)) for p in parts]
    high = sum(len(p) for p, r in zip(parts, ratios) if r > of(len(p))[1])
    low = sum(len(p) for p, r in zip(parts, ratios) if r < of(len(p))[0])
    verdict = "keep"
    if whole > of(len(b))[1] or high >= share * len(b):
        verdict = "repetitive"
    elif whole < of(len(b))[0] or low >= share * len(b):
        verdict = "incompressible"
    return round(whole, 4), round(min(ratios), 4), round(max(ratios), 4), verdict


def test_compression_query_by_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op5_compression(spark, data).collect():
        assert (r["ratio"], r["least_chunk"], r["largest_chunk"], r["verdict"]) == plain_rating(texts[r["doc_id"]]) and r["keep"] == (r["verdict"] == "keep")


def test_compression_odd_tables(odd, table):
    from odd import ODD

    noise = "".join(random.Random(2).choice(string.ascii_letters + string.digits) for _ in range(9000))
    rows = [*ODD, (20, "a" * 31), (21, "ha " * 15), (22, noise), (23, "x" * 5000 + noise), (24, noise[:4096] + "y" * 100)]
    got = sorted((r["doc_id"] or 0, r["ratio"] or 0, r["least_chunk"] or 0, r["largest_chunk"] or 0, r["verdict"]) for r in B.rated(table(rows)).collect())
    want = []
    for row in rows:
        a, b, c, v = plain_rating(row[1])
        want.append((row[0] or 0, a or 0, b or 0, c or 0, v))
    assert got == sorted(want) and B.rated(table([])).collect() == [] and B.rated(odd).columns == ["doc_id", "ratio", "least_chunk", "largest_chunk", "verdict", "keep"]
    assert {g[0]: g[4] for g in got}[20] == "repetitive"


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = B.rated(docs).join(docs.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["keep"] for r in rows if r["quality"] == 1)


# ---- sketches


def test_peeling_recovers_what_differs():
    r = np.random.default_rng(2)
    for d in (0, 1, 5, 20, 200):
        common, a, b = (r.integers(0, 1 << 60, n) for n in (500, d, d // 2))
        cells = P.CELLS
        while (got := P.peel(P.subtract(P.sketch(np.unique(np.concatenate((common, a))), cells), P.sketch(np.unique(np.concatenate((common, b))), cells)))) is None:
            cells *= P.GROW
        assert got[0].tolist() == sorted(a.tolist()) and got[1].tolist() == sorted(b.tolist())


def test_too_small_a_sketch_is_noticed():
    many = np.arange(1000, dtype=np.int64) * 7919
    assert P.peel(P.subtract(P.sketch(many, 48), P.sketch(many[:1], 48))) is None


def test_versions_same_as_sql(spark, data):
    compare.same(op6_version_differences(spark, data), compare.tables(data), ORACLE_SQL["op6_version_differences"])


def test_versions_that_differ_much(spark, table):
    import hashlib

    least = min((f"p{i}" for i in range(2000)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    a, b = [least, *(f"left {i}" for i in range(600))], [least, *(f"right {i}" for i in range(300))]
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()[:15]
    if min(map(digest, a + b)) != digest(least):  # keep only lines whose digest is larger
        a, b = ([x for x in v if digest(x) >= digest(least)] for v in (a, b))
    rows = {r["doc_id"]: r for r in P.version_differences(table([(1, "\n".join(a)), (2, "\n".join(b)), (3, "alone")]), threshold=0.001).collect()}
    assert (rows[2]["base_id"], rows[2]["class_id"], rows[1]["n_links"], rows[3]["n_links"]) == (1, 1, 1, 0) and rows[1]["base_id"] is None and rows[3]["only_doc"] is None
    assert rows[2]["only_base"].split(",") == sorted(map(digest, a[1:])) and rows[2]["only_doc"].split(",") == sorted(map(digest, b[1:]))


def plain_versions(rows, threshold=0.5):
    """One tuple per id, by comparing all pairs of ids."""
    import hashlib

    sets = {}
    for d, text in rows:
        if d is not None:
            sets.setdefault(d, set()).update(hashlib.md5(x.encode()).hexdigest()[:15] for x in {x.strip(" ") for x in (text or "").split("\n")} - {""})
    near = {d: {} for d in sets}
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
                near[a][b] = s
    out = []
    for d in sets:
        group, todo = {d}, [d]
        while todo:
            for x in near[todo.pop()]:
                if x not in group:
                    group.add(x)
                    todo.append(x)
        earlier = sorted((-s, x) for x, s in near[d].items() if x < d)
        if earlier:
            base = earlier[0][1]
            u, v = sorted(sets[base] - sets[d]), sorted(sets[d] - sets[base])
            out.append((d, min(group), len(near[d]), base, len(u), len(v), ",".join(u), ",".join(v)))
        else:
            out.append((d, min(group), len(near[d]), None, None, None, None, None))
    return sorted(out)


def test_versions_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, P.version_differences(docs).collect())) == plain_versions([tuple(r) for r in docs.collect()])


def test_versions_that_share_no_least_digest(table):
    r = random.Random(4)
    line = lambda: " ".join(r.choice(string.ascii_lowercase) * 3 for _ in range(6))
    rows = []
    for k in range(40):
        own = [line() for _ in range(r.choice([1, 2, 4, 10]))]
        for v in range(4):
            rows.append((10 * k + v, "\n".join(x if r.random() < 0.8 else line() for x in own)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:25])]
    assert sorted(map(tuple, P.version_differences(table(rows)).collect())) == plain_versions(rows)


def test_versions_over_boilerplate_are_counted_not_listed(table, monkeypatch):
    from memquarry.llm import ngram_join, set_join

    most = []

    def written(df, name):
        out = plain(df, name)
        most.append((out.count(), name))
        return out

    plain = set_join.written
    for module in (P, ngram_join, set_join):
        monkeypatch.setattr(module, "written", written)
    rows = [(i, f"paragraph {i}\nshared by all\nand this, too") for i in range(300)]
    rows += [(300 + i, t) for i, (_, t) in enumerate(rows[:90])]  # copies, whose own paragraphs aren't of one row
    assert sorted(map(tuple, P.version_differences(table(rows)).collect())) == plain_versions(rows)
    assert max(most)[0] <= 4 * len(rows), max(most)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75])
def test_versions_of_mixed_boilerplate(table, threshold):
    r = random.Random(21)
    common, rows = [f"line {k}" for k in range(6)], []
    for i in range(260):
        own = [f"own {i} {k}" for k in range(r.choice([0, 1, 1, 2, 3]))]
        rows.append((r.randrange(10_000) * 300 + i, "\n".join(r.sample(common, r.randrange(5)) + own)))
    for i, (_, text) in enumerate(rows[:80]):
        rows.append((r.randrange(10_000) * 300 + 260 + i % 40, text if i % 3 else "\n".join([*text.split("\n")[1:], f"new {i}"])))
    rows.append((5, "\n".join(common)))
    assert sorted(map(tuple, P.version_differences(table(rows), threshold).collect())) == plain_versions(rows, threshold)


def test_version_odd_tables(odd, table):
    from odd import ODD

    assert P.version_differences(table([])).collect() == []
    assert sorted(map(tuple, P.version_differences(odd).collect())) == plain_versions([r[:2] for r in ODD])
    rows = [(1, "x\n\n x \ny"), (1, "z"), (2, "z\ny\nx"), (3, None), (None, "x"), (4, "  \n"), (5, "x"), (5, "x")]
    assert sorted(map(tuple, P.version_differences(table(rows)).collect())) == plain_versions(rows)


def brute_versions(rows, threshold=0.5):
    """(a, b) -> (paragraphs only in a, only in b), of all pairs, from the texts."""
    import hashlib
    import re

    kept = []
    for d, text in rows:
        lines = {x.strip(" ") for x in (text or "").split("\n")} - {""}
        words = re.findall(r"\w+", (text or "").lower())
        if lines:
            kept.append((d, {hashlib.md5(x.encode()).hexdigest()[:15] for x in lines}, {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()))
    out = {}
    alike = lambda a, b: bool(a and b) and len(a & b) >= threshold * len(a | b)
    for i, (d, p, g) in enumerate(kept):
        for e, q, h in kept[:i]:
            if alike(p, q) or alike(g, h):
                (x, u), (y, v) = sorted(((d, p), (e, q)), key=lambda z: z[0])
                out[x, y] = (len(u - v), len(v - u), ",".join(sorted(u - v)), ",".join(sorted(v - u)))
    return out


def test_version_pairs_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_versions([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {(r["doc_a"], r["doc_b"]): tuple(r)[2:] for r in P.version_pairs(docs).collect()}
    assert got == want


def test_version_pairs_of_edited_texts(table):
    r = random.Random(9)
    line = lambda: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(8))
    rows, want = [], set()
    for k in range(0, 120, 2):  # one paragraph with a changed word, and ten of which the one with the least digest is changed
        one = " ".join(line() for _ in range(4))
        rows += [(k, one), (k + 1, one.replace(one.split()[9], "changed"))]
        want.add((k, k + 1))
    for k in range(200, 320, 2):
        ten = [line() for _ in range(10)]
        import hashlib

        least = min(ten, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        rows += [(k, "\n".join(ten)), (k + 1, "\n".join(line() if t == least else t for t in ten))]
        want.add((k, k + 1))
    got = {(r["doc_a"], r["doc_b"]): tuple(r)[2:] for r in P.version_pairs(table(rows)).collect()}
    brute = brute_versions(rows)
    assert set(brute) == want and got == brute


def test_version_pairs_odd_tables(odd, table):
    assert P.version_pairs(table([])).collect() == []
    assert P.version_pairs(odd).count() >= 0
    rows = table([(1, "x\n\n x \ny"), (1, "z"), (2, "z\ny\nx"), (3, None), (None, "x"), (4, "z\ny\nw")])
    digest = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()[:15]
    got = {tuple(r) for r in P.version_pairs(rows).collect()}
    assert got == {(1, 2, 0, 0, "", ""), (1, 4, 1, 1, digest("x"), digest("w")), (2, 4, 1, 1, digest("x"), digest("w"))}


# ---- grammars


def test_grammar_round_trip_and_random_access():
    r = random.Random(6)
    docs = [[r.randrange(6) for _ in range(r.randrange(0, 400))] for _ in range(60)] + [[7] * 1000, [1, 2] * 300, []]
    lengths = np.array([len(d) for d in docs])
    seq, symbols, rules, sizes = R.compress(np.array([x for d in docs for x in d], np.int32), lengths, 4)
    assert len(seq) < 0.7 * lengths.sum() and symbols.sum() == len(seq)
    at = np.cumsum(symbols) - symbols
    for d, a, n in zip(docs, at, symbols):
        own = seq[a : a + n]
        assert R.expand(own, rules, sizes) == d
        for _ in range(5):
            i, j = r.randrange(0, len(d) + 2), r.randrange(0, len(d) + 5)
            assert R.expand(own, rules, sizes, i, j) == d[i:j]
    # no pair inside a document is left that occurs min_count times without overlaps
    count = {}
    for a, n in zip(at, symbols):
        own, k = seq[a : a + n].tolist(), 0
        for k in range(len(own) - 1):
            count.setdefault((own[k], own[k + 1]), []).append((a, k))
    for (x, y), places in count.items():
        if x != y:
            assert len(places) < 8


def test_shards_hold_the_tokenizers_ids(spark, data):
    known = C.encoding(C.RANKS)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    seen = []
    for row in [*op7_repair_shards(spark, data).collect(), *R.shards(spark.read.parquet(f"{data}/documents.parquet"), shard_tokens=5000, min_count=2).collect()]:
        for d, n in zip(row["doc_ids"], row["n_tokens"]):
            ids = known.encode_ordinary(texts[d])
            assert len(ids) == n and R.read_document(row, d) == ids and R.read_document(row, d, 3, 9) == ids[3:9]
            seen.append(d)
    assert sorted(seen) == sorted([*texts, *texts])


def test_texts_over_several_shards_and_repeated_ids(table):
    long = " ".join(f"{k % 977}" for k in range(1_600_000))
    known = C.encoding(C.RANKS)
    docs = table([(1, "first"), (2, long), (3, "a b c"), (3, "another text"), (3, "a b c"), (2, "after it"), (None, "no id")]).coalesce(1)
    made = R.shards(docs)
    rows = made.collect()
    whole = known.encode_ordinary(long)
    assert len(whole) > 1 << 21 and len(rows) > 1
    assert R.read_document(rows, 2) == whole and R.read_document(rows[::-1], 2, 2_000_000, 2_200_000) == whole[2_000_000:2_200_000]
    assert R.read(made, 2, len(whole) - 5) == whole[-5:] and R.read(made, 2, copy=1) == known.encode_ordinary("after it")
    assert [R.read(made, 3, copy=k) for k in range(3)] == [known.encode_ordinary(t) for t in ("a b c", "another text", "a b c")]
    with pytest.raises(KeyError):
        R.read(made, 3, copy=3)
    with pytest.raises(KeyError):
        R.read(made, 99)


def test_vocabularies():
    tokens = np.array([70_000, 5, 70_000, 5, 70_000, 5], np.int32)
    seq, symbols, rules, sizes = R.compress(tokens, np.array([6]), 2, 1 << 17)
    assert R.expand(seq, rules, sizes, terminals=1 << 17) == tokens.tolist()
    with pytest.raises(ValueError):
        R.compress(tokens, np.array([6]))
    with pytest.raises(ValueError):
        R.compress(tokens, np.array([6]), 2, 1 << 21)


def test_no_pair_is_left_that_repeats():
    r = random.Random(8)
    docs = [[r.randrange(40) for _ in range(r.randrange(3, 200))] for _ in range(80)]
    lengths = np.array([len(d) for d in docs])
    seq, symbols, rules, sizes = R.compress(np.array([x for d in docs for x in d], np.int32), lengths)
    at, seen = np.cumsum(symbols) - symbols, {}
    for a, n in zip(at, symbols):
        own = seq[a : a + n].tolist()
        for k in range(len(own) - 1):
            seen.setdefault((own[k], own[k + 1]), []).append(a + k)
    assert all(len(v) < 2 or (x == y and len(v) < 3) for (x, y), v in seen.items())
    assert [R.expand(seq[a : a + n], rules, sizes) for a, n in zip(at, symbols)] == docs


def test_shard_odd_tables(odd, table):
    rows = R.shards(odd).collect()
    assert sum(len(r["doc_ids"]) for r in rows) == odd.count()
    assert R.shards(table([])).collect() == []


# ---- licences


def test_notices():
    index = S.Index()
    one = lambda t: [(r[0], r[2], t[r[3] : r[4]]) for r in S.scan(t, index)]
    assert one("Some text.\nReleased under the MIT License.") == [("MIT", 1.0, "Released under the MIT License")]
    assert one("x Licensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", 1.0, "Licensed under CC BY-NC 4.0")]
    assert one("x Licensed under CC BY 4.0.") == [("CC-BY-4.0", 1.0, "Licensed under CC BY 4.0")]
    grant = S.TEMPLATES["mit-grant"][1]
    changed = grant.replace("free of charge", "without any charge").replace("sublicense", "sub license")
    (found,) = one("Head. " + changed + " Tail.")
    assert found[0] == "MIT" and 0.9 <= found[1] < 1 and found[2].startswith("Permission is hereby") and found[2].endswith("the Software")
    assert one("the license of the poet is under discussion") == [] and one("") == [] and S.scan(None, index) == []
    assert len(one("Released under the MIT License. " * 5)) == 5
    twice = "Released under the MIT License. " + "word " * 50 + "Licensed under the Apache License, Version 2.0."
    assert [r[0] for r in one(twice)] == ["MIT", "Apache-2.0"]


@pytest.mark.parametrize("name", list(S.TEMPLATES))
def test_every_template_is_found_whole(name):
    index = S.Index()
    licence, text = S.TEMPLATES[name]
    found = S.scan("before it " + text + " after it", index)
    assert (licence, 1.0) in [(r[0], r[2]) for r in found]


def plain_alignment(template, words):
    """The places of equal words on the best local alignment over the whole table, without a band: match 2, mismatch and gap -1, the diagonal preferred."""
    score = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    move, best, at = {}, 0, None
    for i, t in enumerate(template, 1):
        for j, w in enumerate(words, 1):
            options = (0, score[i - 1][j - 1] + (2 if t == w else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            k = max(range(4), key=options.__getitem__)
            score[i][j], move[i, j] = options[k], k
            if options[k] > best:
                best, at = options[k], (i, j)
    out = []
    while at and move.get(at):
        i, j = at
        if move[at] == 1 and template[i - 1] == words[j - 1]:
            out.append((i - 1, j - 1))
        at = {1: (i - 1, j - 1), 2: (i - 1, j), 3: (i, j - 1)}[move[at]]
    return out[::-1]


def plain_notices(text, coverage=0.7):
    """(licence, template, coverage, start, end) by aligning every template with every part of a text that no larger notice has taken."""
    import re
    from collections import Counter

    words = [(m.group(), *m.span()) for m in re.finditer(r"\w+", text.lower())]
    count, found = Counter(w for w, *_ in words), []
    for name, (licence, template) in S.TEMPLATES.items():
        t = re.findall(r"\w+", template.lower())
        if sum((Counter(t) & count).values()) < coverage * len(t):
            continue
        todo = [words]
        while todo:
            part = todo.pop()
            pairs = plain_alignment(t, [w for w, *_ in part])
            if len(pairs) >= coverage * len(t):
                first, last = pairs[0][1], pairs[-1][1]
                found.append((len(pairs), round(len(pairs) / len(t), 4), name, licence, part[first][1], part[last][2]))
                todo += [part[:first], part[last + 1 :]]
    out = []
    for f in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[4])):
        if all(f[5] <= g[4] or f[4] >= g[5] for g in out):
            out.append(f)
    return sorted(((f[3], f[2], f[1], f[4], f[5]) for f in out), key=lambda f: f[3])


def test_notices_query_by_brute_force(spark, data):
    """Templates aligned with whole texts, without fingerprints and bands, give the same licences, templates, coverage and spans."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {d: [] for d in rows}
    for r in sorted(op9_license_notices(spark, data).collect(), key=lambda r: r["span_start"]):
        got[r["doc_id"]].append(tuple(r)[1:])
    assert sum(map(len, got.values())) > 2 and got == {d: plain_notices(t) for d, t in rows.items()}


def test_edited_notices_by_brute_force():
    r, index = random.Random(12), S.Index()
    short = [n for n, ws in zip(index.names, index.words) if len(ws) < 500]
    filler = lambda n: " ".join(r.choice(["stone", "river", "the", "of", "license", "under", "lamp"]) for _ in range(n))
    for _ in range(40):
        parts = []
        for name in r.sample(short, 2):
            words = S.TEMPLATES[name][1].split()
            for _ in range(len(words) // 12):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice([["edited"], [], [words[k], "inserted"]])
            parts += [filler(30), " ".join(words)]
        text = " ".join([*parts, filler(30)])
        assert S.scan(text, index) == plain_notices(text)


def test_full_licences_with_changes():
    r, index = random.Random(13), S.Index()
    for name in S.FULL_TEXTS:
        licence, text = S.TEMPLATES[name]
        words = text.split()
        for _ in range(len(words) // 60):
            words[r.randrange(len(words))] = "changed"
        changed = "A head. " + " ".join(words) + " A tail of some words."
        (found,) = [f for f in S.scan(changed, index) if f[1] == name]
        assert found[0] == licence and 0.95 <= found[2] < 1 and found[3] <= 40 and found[4] >= len(changed) - 60
        half = " ".join(words[: len(words) // 2])
        assert not [f for f in S.scan(half, index) if f[1] == name]


def test_notice_odd_tables(odd, table):
    assert S.notices(odd).collect() == [] and S.notices(table([])).collect() == []
    rows = table([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, "İ Released under the MIT License.")])
    assert S.notices(rows).count() == 4
