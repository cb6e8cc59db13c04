import numpy as np
import pytest

from memquarry.llm import langid as L
from memquarry.llm.queries import op10_language

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs, sample_per_lang=80)


def test_document_frequencies_cover_every_document(docs, spark):
    df, n = L.document_frequencies(docs)
    texts = [r["text"] for r in docs.select("text").collect()]
    want = np.zeros(1 << 15, np.int64)
    for t in texts:
        want[np.unique(L.grams(t, 1 << 15)[0])] += 1
    assert n == len(texts) and (df == want).all()


def test_held_out_accuracy(docs, model):
    rows = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["predicted"] == r["lang"] for r in rows if not r["rejected"])
    assert right >= 0.98 * sum(not r["rejected"] for r in rows)  # 80 documents a language were fitted on, of 1000
    assert sum(r["rejected"] for r in rows) <= 0.005 * len(rows)


def test_foreign_texts_are_rejected(table, model):
    rows = [(1, "これは日本語の文章です。" * 20), (2, "съешь же ещё этих мягких французских булок да выпей чаю " * 10), (3, "qzxv kjwq xzzq vvkq jqxz " * 60), (4, "%%% *** 123 456 !!!"), (5, ""), (6, None), (7, "   \n")]
    got = {r["doc_id"]: (r["predicted"], r["rejected"]) for r in L.identify(table(rows), model).collect()}
    assert all(v == (None, True) for v in got.values())
    assert L.keep_identified(table(rows), model).count() == 0


def test_nearest_centroid_by_brute_force(docs, model):
    for r in docs.limit(40).collect():
        g, _ = L.grams(r["text"], model.dims)
        v = np.log1p(np.bincount(g, minlength=model.dims)).astype(np.float32) * model.idf
        cos = v @ model.centroids / np.linalg.norm(v)
        assert L.similarities(model, r["text"])[:2] == (model.langs[int(cos.argmax())], pytest.approx(float(cos.max()), abs=1e-4))


def test_query(spark, data):
    rows = op10_language(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count() and sum(r["rejected"] for r in rows) <= 2


def test_odd_tables(odd, table, model):
    assert L.identify(odd, model).count() == odd.count()
    kept = L.keep_identified(odd, model)
    assert kept.schema == odd.schema and L.keep_identified(table([]), model).count() == 0
    assert L.fit(odd, sample_per_lang=3).dims == 1 << 15
    nothing = L.fit(table([(1, "no label at all"), (2, None, "en")]))
    assert nothing.langs == [] and L.identify(table([(1, "text")]), nothing).first()["rejected"]
    assert L.fit(table([])).langs == []


def test_copies_neither_fill_nor_empty_a_sample(spark, docs, table):
    german = [r["text"] for r in docs.where("lang = 'de'").limit(200).collect()]
    english = [r["text"] for r in docs.where("lang = 'en'").limit(40).collect()]
    rows = [(i, t, "de") for i, t in enumerate(german)] + [(1000 + i, "the one sentence of this language", "en") for i in range(20_000)]
    model = L.fit(table(rows), sample_per_lang=50)
    assert sorted(set(model.langs)) == ["de", "en"]
    mixed = rows + [(30_000 + i, t, "en") for i, t in enumerate(english)]
    model = L.fit(table(mixed), sample_per_lang=30)
    own = [L.similarities(model, t)[0] for t in english]
    assert own.count("en") >= 0.95 * len(own) and L.similarities(model, "the one sentence of this language")[0] == "en"


def test_ties_take_the_first_language():
    one = np.zeros((1 << 15, 2), np.float32)
    at, w, _ = L.vector("some words", 1 << 15)
    one[at, 0] = one[at, 1] = w / np.linalg.norm(w)
    model = L.Model(["aa", "bb"], one, np.ones(1 << 15, np.float32), np.zeros(len(L.BANDS) + 1), 1 << 15)
    assert L.similarities(model, "some words") == ("aa", pytest.approx(1.0, abs=1e-5), True)


def plain_vector(text, model):
    """The TF-IDF vector by its definition: grams counted one by one."""
    letters = ["".join(c if c.isascii() and c.isalpha() or ord(c) >= 0xC0 else " " for c in text.lower())][0]
    padded = " " + letters + " "
    squeezed = padded[0] + "".join(b for a, b in zip(padded, padded[1:]) if not (a == b == " "))
    code = [0 if c == " " else ord(c) for c in squeezed]
    m64, a, b = (1 << 64) - 1, 0x1F123BB5, 0x9E3779B97F4A7C15
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            if n == 1 and not code[i]:
                continue
            x = 0
            for c in code[i : i + n]:
                x = (x * a + c) & m64
            g = ((x + n) * b & m64) >> (64 - 15)
            counts[g] = counts.get(g, 0) + 1
    v = {g: np.log1p(k) * model.idf[g] for g, k in counts.items()}
    norm = np.sqrt(sum(x * x for x in v.values()))
    return {g: x / norm for g, x in v.items()}, sum(c != " " for c in letters)


def test_assignment_and_rejection_by_brute_force(docs, model):
    for r in docs.orderBy("doc_id").limit(60).collect():
        text = r["text"][:2000]
        v, letters = plain_vector(text, model)
        cos = [sum(x * float(model.centroids[g, k]) for g, x in v.items()) for k in range(len(model.langs))]
        k = int(np.argmax(cos))
        limit = model.limits[sum(letters >= b for b in L.BANDS)]
        lang, s, ok = L.similarities(model, text)
        assert lang == model.langs[k] and s == pytest.approx(cos[k], abs=1e-4) and ok == (cos[k] >= limit)


def test_clusters_are_local_optima():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.15, (40, 6)) for c in np.eye(6)[:4]]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = L._clusters(x, 4, np.random.default_rng(1))
    own = (x @ centres.T).argmax(axis=1)
    assert sorted(np.bincount(own, minlength=4)) == [40] * 4  # the four groups that were drawn
    for k in range(4):
        mean = x[own == k].sum(axis=0)
        assert np.allclose(centres[k], mean / np.linalg.norm(mean), atol=1e-5)
