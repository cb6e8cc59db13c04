"""Token counts of documents under a byte-level BPE vocabulary, without making ids.

Merges never reach over a pre-token, so the pieces of each distinct pre-token are counted once and a document's count is the sum over its
pre-tokens of frequency times pieces. The most frequent pre-tokens (`head`, a fixed number, about all of the occurrences in prose) are looked up
where the documents are read; the frequencies of the others are joined to the table of distinct pre-tokens by shuffle. Both parts are exact at every size of the vocabulary.
"""

from __future__ import annotations

import gc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.llm.common import TOKENIZER_DIR, byte_ranks, character_sums, gathered, mapped, only_model, order_of, pre_tokens, regrouped, slices, written

RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
HEAD = 400_000

def encoding(path: str):
    return only_model(("ranks", path), lambda: byte_ranks(path))


_SPACES: list = []


def _spaces() -> np.ndarray:
    """By code point whether it is white space."""
    if not _SPACES:
        _SPACES.append(np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000))
    return _SPACES[0]


def _cut(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By part of the texts that can be cut: a 64-bit hash, its text, its place there and its size; by text the number of parts, and whether it can't be cut.

    A part begins at each space and line feed and, with a NUL in front, at the start of a text. A text can't be cut where white space stands beside a space or line feed, at its start or end, or where it holds a NUL.
    """
    out, counts, uneven = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for i, j in slices(texts, 2_000_000):  # so that what is worked on fits in a processor's cache
        own = [t or "" for t in texts[i:j]]
        c = np.frombuffer(("\0" + "\0".join(own) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        mark = np.cumsum(sizes + 1) - sizes - 1
        nul = c == 0
        cut = (c == 32) | (c == 10) | nul
        space = _spaces()[c] | nul
        nul[mark] = nul[-1] = False
        nul[:-1] |= space[:-1] & space[1:] & (cut[:-1] | cut[1:])
        bad = np.zeros(len(own), bool)
        bad[np.searchsorted(mark, np.flatnonzero(nul), side="right") - 1] = True
        bad &= sizes > 0
        start = np.flatnonzero(cut[:-1])
        size = np.diff(np.append(start, len(c) - 1))
        text = np.searchsorted(mark, start, side="right") - 1
        h = character_sums(c[:-1], start, size)
        kept = ((sizes > 0) & ~bad)[text]
        text, start, size = text[kept], start[kept], size[kept]
        out.append((h[kept], text + i, start - mark[text] - 1, size))
        counts[i:j] = np.bincount(text, minlength=len(own))
        uneven[i:j] = bad
    parts = [np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(4)]
    return *parts, counts, uneven


def parts_of(texts: list, known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and sizes of the distinct parts of the texts, and by text the parts it consists of: their numbers, and how many.

    Where a text's spaces and line feeds stand alone, each between two characters that are no white space, a pre-token begins at each. Such a text is cut there; parts are told apart by hashes of 64 bits and their sizes
    (two of a million differ in neither with a probability below 1e-7), the distinct ones are encoded at once, one a line, and told apart by the line feed's id. Any other text is a part of its own.
    """
    (feed,) = known.encode_ordinary("\n")
    h, text, place, size, lengths, uneven = _cut(texts)
    order = order_of(h)
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    distinct = [texts[t][p + 1 : p + n] if p < 0 else texts[t][p : p + n] for t, p, n in zip(text[first].tolist(), place[first].tolist(), size[first].tolist())]
    fed = np.fromiter((p[0] == "\n" for p in distinct), bool, len(distinct)) & (place[first] >= 0)
    lines = "\n".join([p[1:] if f else p for p, f in zip(distinct, fed.tolist())])
    pool = np.append(known.encode_to_numpy(lines, disallowed_special=()).astype(np.int32), np.int32(feed))
    ends = np.flatnonzero(pool == feed)[: len(distinct)]
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(distinct) else ends
    # a part that begins a line has the feed in front: that of the line before, or the last one of the pool
    if len(fed) and fed[0]:
        pool, starts, ends = np.concatenate(([np.int32(feed)], pool)), starts + 1, ends + 1
    starts = starts - fed
    sizes = ends - starts
    if uneven.any():
        whole = np.flatnonzero(uneven)
        more = [known.encode_to_numpy(texts[t], disallowed_special=()).astype(np.int32) for t in whole.tolist()]
        before = np.cumsum(lengths) - lengths
        number = np.insert(number, before[whole], len(sizes) + np.arange(len(whole)))
        lengths[whole] = 1
        own = np.fromiter(map(len, more), np.int64, len(more))
        starts = np.concatenate((starts, len(pool) + np.cumsum(own) - own))
        sizes = np.concatenate((sizes, own))
        pool = np.concatenate((pool, *more))
    return pool, starts, sizes, number, lengths


def _by_text(per_part: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums, edges = np.concatenate(([0], np.cumsum(per_part))), np.concatenate(([0], np.cumsum(lengths)))
    return sums[edges[1:]] - sums[edges[:-1]]


def encoded(texts: list, known) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of the texts, and how many each has; none for a null or empty one."""
    pool, starts, sizes, at, lengths = parts_of(texts, known)
    return gathered(pool, starts[at], sizes[at]), _by_text(sizes[at], lengths)


def text_counts(texts: list, known) -> list:
    """The exact number of tokens of each text; None for a null one."""
    _, _, sizes, at, lengths = parts_of(texts, known)
    return [None if t is None else n for t, n in zip(texts, _by_text(sizes[at], lengths).tolist())]


def with_counts(docs: DataFrame, columns: list[str], text: str = "text", path: str = RANKS, name: str = "n_tokens") -> DataFrame:
    """The columns named and the token count of each row, in one pass without a shuffle: each task counts its distinct pre-tokens once."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        gc.disable()
        for b in regrouped(batches, len(columns)):
            texts = b.column(len(columns)).to_pylist()
            counts = pa.array([n for i, j in slices(texts) for n in text_counts(texts[i:j], encoding(path))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], counts], names=[*columns, name])

    return mapped(docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).alias("__text")), run, f"{fields}, {name} long")


def distinct_pre_tokens(docs: DataFrame, text: str = "text", path: str = RANKS) -> DataFrame:
    """pre, n, pieces: each distinct pre-token of all texts, its occurrences, and its number of pieces, counted once."""

    def occurrences(batches):
        split, seen = pre_tokens(), Counter()
        gc.disable()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(split(t))
                if len(seen) > 600_000:
                    yield batch(seen)
                    seen = Counter()
        yield batch(seen)

    def batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pre", "n"])

    def pieces(batches):
        single = encoding(path).encode_ordinary
        for b in batches:
            counts = [len(single(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int32())], names=["pre", "n", "pieces"])

    seen = mapped(docs.select(F.col(text)), occurrences, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return mapped(seen, pieces, "pre string, n long, pieces int")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens: one row per id, over all its rows.

    Rows that repeat an id add up; null ids form one row; null and empty texts count 0; an empty table gives an empty one. Texts that look like special tokens are ordinary text. Texts are
    counted whole, however long; ties of frequency at the head's edge change nothing in the result. Other columns, whatever their names, aren't read.
    Two passes over the texts. Shuffled are the tasks' distinct pre-tokens, and the frequencies of those outside the head.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = written(distinct_pre_tokens(texts, "text", path), "pre-tokens")
    # the head is all pre-tokens of at least the frequency that keeps it within bounds; frequencies' histogram is short, a sort of the table isn't needed
    above = table.groupBy("n").count().withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("n"))))
    bar = above.where(F.col("upto") <= head).agg(F.min("n")).first()[0]
    top = table.where(F.col("n") >= (bar if bar is not None else (1 << 62))).select("pre", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("pre").to_pylist(), top.column("pieces").to_pylist())))  # at most `head` entries

    def frequencies(batches):
        head_pieces, split = known.value, pre_tokens()
        gc.disable()
        for b in regrouped(batches, 1):
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                rows, sums, lengths, tail_of, tail, times = [], [], [], [], [], []
                for k in range(i, j):
                    pre = split(texts[k]) if texts[k] else []
                    rest = [p for p in pre if p not in head_pieces]
                    rows.append(k)
                    if rest:
                        sums.append(sum([head_pieces.get(p, 0) for p in pre]))
                        for p, n in Counter(rest).items():
                            tail_of.append(k)
                            tail.append(p)
                            times.append(n)
                    else:
                        sums.append(sum(map(head_pieces.__getitem__, pre)))
                    lengths.append(len(pre))
                ids = b.column(0).take(pa.array(rows + tail_of, pa.int64()))
                own = [f"\0{k}" for k in rows]  # no pre-token holds both; spreads these rows over the partitions of the join
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own + tail, pa.string()), pa.array(sums + times, pa.int64()), pa.array(lengths + [0] * len(tail), pa.int64())],
                    names=["doc_id", "pre", "k", "pre_tokens"],
                )

    freq = mapped(texts, frequencies, f"doc_id {kind}, pre string, k long, pre_tokens long")
    joined = freq.join(table.select("pre", "pieces"), "pre", "left")  # rows of sums match nothing: theirs is a frequency of one piece
    return joined.groupBy("doc_id").agg(F.sum(F.col("k") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"), F.sum("pre_tokens").alias("n_pre_tokens"))
