from collections import Counter

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from memquarry.llm import token_counts as C
from memquarry.llm.common import PRE_TOKEN, pre_tokens

KNOWN = C.encoding(C.RANKS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'abcXYZ019.,!²é\xa0\x00\x1c 日"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_parts_give_the_tokenizers_ids(texts):
    ids, counts = C.encoded(texts, KNOWN)
    want = [KNOWN.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pre_tokens_join_to_the_text(text):
    found = pre_tokens()(text)
    assert "".join(found) == text
    assert found == regex.findall(PRE_TOKEN, text) or any(c in text for c in "\x1c\x1d\x1e\x1f")


def brute(rows):
    out = {}
    for doc_id, text in rows:
        n, k = out.get(doc_id, (0, 0))
        out[doc_id] = (n + (len(KNOWN.encode_ordinary(text)) if text else 0), k + (len(pre_tokens()(text)) if text else 0))
    return out


def test_counts_at_every_size_of_the_head(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for head in (0, 50, C.HEAD):
        assert {r["doc_id"]: (r["n_tokens"], r["n_pre_tokens"]) for r in C.token_counts(docs, head=head).collect()} == want


def test_distinct_pre_tokens(table):
    docs = table([(1, "a b a"), (2, None), (3, "a b")])
    want = Counter(p for t in ("a b a", "a b") for p in pre_tokens()(t))
    assert {r["pre"]: r["n"] for r in C.distinct_pre_tokens(docs).collect()} == want


def test_odd_tables(odd, table):
    from odd import ODD

    assert {r["doc_id"]: (r["n_tokens"], r["n_pre_tokens"]) for r in C.token_counts(odd).collect()} == brute([r[:2] for r in ODD])
    assert C.token_counts(table([])).collect() == []
    assert C.with_counts(table([]), ["doc_id"]).collect() == []
    assert {(r["doc_id"], r["n_tokens"]) for r in C.with_counts(table([(1, None), (2, "<|endoftext|>")]), ["doc_id"]).collect()} == {(1, None), (2, len(KNOWN.encode_ordinary("<|endoftext|>")))}
