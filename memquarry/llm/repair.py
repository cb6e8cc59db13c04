"""Token ids in binary shards, compressed by Re-Pair grammars that allow random access.

Within a shard the most frequent pairs of neighbouring symbols are replaced by nonterminals, again and again, until no pair inside a document
occurs `min_count` times (twice, unless more is asked for). A rule has two symbols; with every rule the number of tokens that it expands to is stored, so that a range of a
document's tokens is decoded without expanding what lies before it. No pair reaches over the end of a document.

Pairs are replaced in rounds. A round takes all pairs that occur at least as often as a bar, the count of the most frequent pair over `FALL`; where two occurrences overlap, the one of the
more frequent pair is replaced, in a run of one symbol every second one.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import mapped, regrouped, slices
from memquarry.llm.token_counts import RANKS, encoded, encoding

SHARD = 1 << 20  # tokens after which a shard is closed; a document stays whole while it has at most _MOST
MIN_COUNT, FALL = 2, 64
_BITS = 21
_AT_ONCE = 16_000_000  # characters of which the distinct parts are encoded once
_MOST = 1 << _BITS


def compress(tokens: np.ndarray, lengths: np.ndarray, min_count: int = MIN_COUNT, terminals: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols of each document, rules (n x 2), and the rules' expansion lengths, for at most 2 ** 21 tokens below `terminals`, from which on rules are numbered, of documents of the given lengths."""
    if len(tokens) > _MOST or terminals > _MOST // 2 or (len(tokens) and int(tokens.max()) >= terminals):
        raise ValueError("a shard holds at most 2 ** 21 tokens of a vocabulary of at most 2 ** 20")
    seq = tokens.astype(np.int64)
    last = np.zeros(len(seq), bool)
    ends = np.cumsum(lengths)
    last[ends[lengths > 0] - 1] = True
    rules, bar, top = [], _MOST, terminals
    alive = ~last  # places whose pair may still be frequent: an old pair's count only falls
    while len(seq) > 1:
        at = np.flatnonzero(alive)
        keys = seq[at] << (2 * _BITS) | seq[at + 1] << _BITS | at
        keys.sort()
        pair = keys >> _BITS
        edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
        count = np.diff(edge)
        if not len(pair) or count.max() < max(2, min_count):
            break
        bar = min(bar, max(min_count, int(count.max()) // FALL))
        often = np.flatnonzero(count >= min_count)
        order = often[np.argsort(count[often], kind="stable")]  # rank 1 is the rarest
        rank = np.zeros(len(count), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        least = np.searchsorted(count[order], bar) + 1  # the least rank at the bar
        here = keys & (_MOST - 1)
        ranks = np.repeat(rank, count)
        frequent = ranks > 0
        by_place = np.zeros(len(seq) + 1, np.int32)
        by_place[here[frequent]] = ranks[frequent]
        alive = by_place[:-1] > 0
        here = np.flatnonzero(by_place >= least)
        r = by_place[here]
        before = np.where(here > 0, by_place[here - 1], 0)
        run = before == r  # only pairs of one symbol follow themselves
        begin = np.maximum.accumulate(np.where(run, -1, np.arange(len(here))))
        even = ((np.arange(len(here)) - begin) & 1) == 0
        kept = here[even & (before <= r) & (by_place[here + 1] <= r)]
        of = by_place[kept]
        good = np.bincount(of, minlength=len(order) + 1) >= min_count
        enough = good[of]
        kept, of = kept[enough], of[enough]
        if not len(kept):
            if bar == min_count:
                break
            bar = max(min_count, bar // FALL)
            continue
        number = np.cumsum(good) - 1
        new = pair[edge[:-1][order[np.flatnonzero(good) - 1]]]
        rules.append(np.stack((new >> _BITS, new & (_MOST - 1)), axis=1))
        seq[kept] = top + number[of]
        last[kept] = last[kept + 1]
        alive[kept] = True
        alive[kept[kept > 0] - 1] = True
        stay = np.ones(len(seq), bool)
        stay[kept + 1] = False
        seq, last, alive = seq[stay], last[stay], alive[stay]
        alive &= ~last
        top += len(new)
    found = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    size = np.ones(top, np.int64)
    for k, (a, b) in enumerate(found.tolist(), terminals):
        size[k] = size[a] + size[b]
    symbols = np.zeros(len(lengths), np.int64)
    symbols[lengths > 0] = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    return seq, symbols, found, size[terminals:]


def expand(symbols, rules: np.ndarray, sizes: np.ndarray, start: int = 0, stop: int | None = None, terminals: int = 1 << 16) -> list[int]:
    """The tokens from start to stop of a document's symbols. Symbols before start are skipped by their lengths, not expanded."""
    symbols = np.asarray(symbols, np.int64)
    long = symbols >= terminals
    own = np.ones(len(symbols), np.int64)
    own[long] = sizes[symbols[long] - terminals]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    start = max(0, start)
    if start >= stop:
        return []
    first = int(np.searchsorted(ends, start, side="right"))
    place, out, k = int(ends[first] - own[first]), [], first
    while place < stop:
        stack = [int(symbols[k])]
        k += 1
        while stack and place < stop:
            s = stack.pop()
            n = 1 if s < terminals else int(sizes[s - terminals])
            if place + n <= start:
                place += n
            elif s < terminals:
                out.append(s)
                place += 1
            else:
                a, b = rules[s - terminals]
                stack += [int(b), int(a)]
    return out


def read_document(rows, doc_id, start: int = 0, stop: int | None = None, copy: int = 0) -> list[int]:
    """The tokens from start to stop of one document, from the rows of the shards that hold its id (or one such row), in any order. Of several rows of docs with this id `copy` picks one. Entries that end before start aren't expanded; KeyError where there is no such document."""
    rows = sorted(rows if isinstance(rows, list) else [rows], key=lambda r: r["shard"])
    out, at, seen, found = [], 0, -1, False
    for row in rows:
        ends = np.cumsum(np.asarray(row["n_symbols"], np.int64))
        for place, own in enumerate(row["doc_ids"]):
            if own != doc_id:
                continue
            seen += row["pieces"][place] == 0
            if seen != copy:
                continue
            found = True
            n = int(row["n_tokens"][place])
            if at + n > start and (stop is None or at < stop):
                symbols = np.frombuffer(row["symbols"], "<u4")[int(ends[place] - row["n_symbols"][place]) : int(ends[place])]
                rules, sizes = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4")
                out += expand(symbols, rules, sizes, start - at, None if stop is None else stop - at, int(row["terminals"]))
            at += n
    if not found:
        raise KeyError(doc_id)
    return out


def read(shards: DataFrame, doc_id, start: int = 0, stop: int | None = None, copy: int = 0) -> list[int]:
    """read_document() from the table: only the few shards that hold the id come to the driver."""
    return read_document(shards.where(F.array_contains("doc_ids", doc_id)).collect(), doc_id, start, stop, copy)


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS, shard_tokens: int = SHARD, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per shard: shard, doc_ids, pieces, n_tokens and n_symbols (lists by entry), terminals, symbols, rules, rule_lengths (binary, 4-byte little-endian).

    A shard holds consecutive rows of one task; every row of docs is in exactly one, repeated ones too, null ids as null. Null and empty texts have no tokens. A text of more than 2 ** 21 tokens is laid
    down in several entries of its id, in order, over shards that follow one another; `pieces` counts them from 0, so that read_document() gives it whole. Rules are numbered from `terminals` on, the size of the vocabulary.
    An empty table gives no shards; other columns, whatever their names, aren't read. One pass, no shuffle.
    """

    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        gc.disable()
        held: list[tuple] = []
        tokens = number = 0
        for b in regrouped(batches, 1, _AT_ONCE):
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, _AT_ONCE):
                ids, counts = encoded(texts[i:j], encoding(path))
                ends = np.cumsum(counts)
                for d, n, end in zip(b.column(0).slice(i, j - i).to_pylist(), counts.tolist(), ends.tolist()):
                    own = ids[end - n : end]
                    for piece, part in enumerate([own[k : k + _MOST] for k in range(0, n, _MOST)] or [own]):
                        if held and tokens + len(part) > shard_tokens:
                            yield shard(task, number, held)
                            held, tokens, number = [], 0, number + 1
                        held.append((d, part, piece))
                        tokens += len(part)
        if held:
            yield shard(task, number, held)

    def shard(task, number, held):
        lengths, terminals = np.array([len(p) for _, p, _ in held], np.int64), encoding(path).max_token_value + 1
        seq, symbols, rules, sizes = compress(np.concatenate([p for _, p, _ in held]), lengths, min_count, terminals)
        one = lambda v, t: pa.array([v], t)
        return pa.RecordBatch.from_arrays(
            [
                one(task << 32 | number, pa.int64()),
                pa.array([[d for d, *_ in held]], pa.list_(id_type)),
                one([k for *_, k in held], pa.list_(pa.int32())),
                one(lengths.astype(np.int32), pa.list_(pa.int32())),
                one(symbols.astype(np.int32), pa.list_(pa.int32())),
                one(terminals, pa.int32()),
                *(one(x.astype("<u4").tobytes(), pa.binary()) for x in (seq, rules, sizes)),
            ],
            names=["shard", "doc_ids", "pieces", "n_tokens", "n_symbols", "terminals", "symbols", "rules", "rule_lengths"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    id_type = to_arrow_type(kind)
    return mapped(docs.select(F.col(doc_id), F.col(text)), run, f"shard long, doc_ids array<{kind.simpleString()}>, pieces array<int>, n_tokens array<int>, n_symbols array<int>, terminals int, symbols binary, rules binary, rule_lengths binary")
