import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from memquarry.llm import piece_codec as C

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
MODEL = C.pieces()


def lists(texts, model=MODEL):
    ids, counts, restored = C.encode_texts(model, texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out, restored


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\tabcdeaa.,019▁é日🙂"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_ids_are_the_librarys(texts):
    got, restored = lists(texts)
    assert got == LIBRARY.encode(texts)
    assert restored == ["▁" not in t for t in texts]
    assert [MODEL.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    from memquarry.llm.queries import op4_sentencepiece

    got = op4_sentencepiece(spark, data)
    for r in got.collect():
        assert r["ids"] == LIBRARY.encode(texts[r["doc_id"]]) and r["n_ids"] == len(r["ids"]) and r["restored"]
    assert {r["doc_id"]: r["text"] for r in C.decode(got).collect()} == texts


def test_one_step_leads_to_each_place(spark, data):
    """In a BPE model no second piece may be taken where one is, so the forward score of that one is the largest; the path's score is the sum of its pieces'."""
    words = sorted({"▁" + w for r in spark.read.parquet(f"{data}/documents.parquet").select("text").limit(30).collect() for w in r["text"].split()})[:400]
    for word, ids in zip(words, MODEL.encode_sorted(words)):
        last, forward = [-1], [0.0]
        for d in range(len(word)):
            steps = []
            for length, i in [(n, MODEL.id[word[d + 1 - n : d + 1]]) for n in range(1, d + 2) if word[d + 1 - n : d + 1] in MODEL.id]:
                s = last[d + 1 - length]
                alone = s == -1 and len(MODEL.merged(MODEL.text[i])) == 1
                if alone or s >= 0 and MODEL.merged(MODEL.string(s) + MODEL.text[i]) == [MODEL.string(s), MODEL.text[i]]:
                    steps.append((forward[d + 1 - length] + MODEL.score[i], i))
            assert len(steps) <= 1
            score, i = max(steps, default=(forward[d] + MODEL.least - 10, C._OTHER + ord(word[d])))
            last.append(i)
            forward.append(score)
        if all(i < C._OTHER for i in last[1:]):
            assert ids[-1] == last[-1] and forward[-1] == sum(MODEL.score[i] for i in ids)


def test_unigram_scores(tmp_path):
    """A unigram model with the same pieces and random scores: the plain Viterbi search gives the library's ids."""
    model = proto.ModelProto()
    with open(C.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    r = random.Random(4)
    for p in model.pieces:
        if p.type == 1:
            p.score = -r.randrange(1000, 9000) / 512  # sums are exact in single precision
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    own, library = C.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(r.choice(["the", "ing", "re", " ", "a", "st", "é", "🙂"]) for _ in range(20)) for _ in range(60)]
    got, want = lists(texts, own)[0], library.encode(texts)
    total = lambda ids: sum(own.score.get(i, own.least - 10) for i in ids)
    for a, b in zip(got, want):
        assert a == b or abs(total(a) - total(b)) < 1e-9  # ties may fall either way


def test_odd_tables(odd, table):
    rows = C.encode(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["ids"] is None) == (r["restored"] is None)
    want = sorted(len(LIBRARY.encode(r["text"])) for r in odd.collect() if r["text"] is not None)
    assert sorted(r["n_ids"] for r in rows if r["n_ids"] is not None) == want
    assert C.encode(table([])).collect() == [] and C.decode(C.encode(table([]))).collect() == []
