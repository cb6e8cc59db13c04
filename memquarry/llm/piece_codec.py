"""SentencePiece encoding and decoding by a Viterbi search that distinct words share.

A text is cut where no piece of the vocabulary can reach across: before every run of spaces and around line feeds. A batch's distinct words, each with its
space mark, are sorted; in that order they are the leaves of a trie met depth first, so the forward scores of a word's prefix are those of its predecessor up to
their common prefix and are kept on a stack. At each place an Aho-Corasick automaton names the pieces that end there.

The forward score of a place is the largest sum of piece scores over the steps that lead there. For a unigram model these are all pieces. A BPE model's segmentation isn't that of the largest sum, so there the
search runs over those steps only that BPE could take: piece t may follow piece s where BPE leaves s + t as these two pieces. Exactly one such step leads to each place, whose score is the largest,
so the search stops at it; the path is BPE's segmentation of the prefix. Both modes give the ids of the library for the same model file.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import TOKENIZER_DIR, gathered, mapped, only_model, regrouped, slices

MODEL = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
_OTHER = 1 << 21  # ids from here on stand for characters outside the vocabulary
_UNKNOWN_PENALTY = 10.0
_RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")


class Pieces:
    """A model file's vocabulary with the automaton over it."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation but the space mark are read")
        self.text = [p.piece for p in model.pieces]
        self.score, self.id, self.bytes = {}, {}, {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type in (1, 4):
                self.id[p.piece], self.score[i] = i, p.score
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.least = min(self.score.values(), default=0.0)
        self.plain = {i: p for p, i in self.id.items()}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id):
            raise ValueError("a piece reaches over a space or a line feed")
        self._automaton()
        self.pairs: dict[int, bool] = {}

    def _automaton(self) -> None:
        self.next, self.fail, self.ends = [{}], [0], [[]]
        for piece, i in self.id.items():
            at = 0
            for ch in piece:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append([])
                at = self.next[at][ch]
            self.ends[at].append((len(piece), i))
        queue = list(self.next[0].values())
        for at in queue:
            for ch, to in self.next[at].items():
                f = self.fail[at]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(ch, 0) if self.next[f].get(ch, 0) != to else 0
                self.ends[to] = self.ends[to] + self.ends[self.fail[to]]
                queue.append(to)

    def _to(self, at: int, ch: str) -> int:
        f = at
        while f and ch not in self.next[f]:
            f = self.fail[f]
        to = self.next[at][ch] = self.next[f].get(ch, 0)  # where a failure leads is kept beside the trie's own steps
        return to

    def string(self, i: int) -> str:
        return chr(i - _OTHER) if i >= _OTHER else self.text[i]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: of all neighbours that make a piece, the pair of the largest score, the leftmost of these, is merged until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, s: int, t: int) -> bool:
        a, b = self.string(s), self.string(t)
        ok = self.pairs[s << 22 | t] = self.merged(a + b) == [a, b]
        return ok

    def encode_sorted(self, words):
        """The ids of each of the sorted distinct marked words, in order, as lists."""
        bpe, ends, step, pairs = self.kind == BPE, self.ends, self.next, self.pairs
        score, lowest = self.score, self.least - _UNKNOWN_PENALTY
        if len(pairs) > 600_000:
            pairs.clear()
        # by depth: automaton state, last piece, its length, forward score
        states, last, size, forward = [0], [-1], [0], [0.0]
        before = ""
        single: dict[int, bool] = {}
        for word in words:
            n, k = len(word), 0
            for x, y in zip(before, word):
                if x != y:
                    break
                k += 1
            del states[k + 1 :], last[k + 1 :], size[k + 1 :], forward[k + 1 :]
            at = states[k]
            for d in range(k, n):
                ch = word[d]
                to = step[at].get(ch)
                at = self._to(at, ch) if to is None else to
                found = ends[at]
                states.append(at)
                if bpe:
                    for length, i in found:
                        b = d + 1 - length
                        s = last[b]
                        if s == -1:
                            ok = single.get(i)
                            if ok is None:
                                ok = single[i] = len(self.merged(self.text[i])) == 1
                        elif s == -2:
                            ok = False
                        else:
                            ok = pairs.get(s << 22 | i)
                            if ok is None:
                                ok = self.follows(s, i)
                        if ok:
                            # no other piece that ends here may be taken: this one's score is the largest
                            last.append(i)
                            size.append(length)
                            forward.append(forward[b] + score[i])
                            break
                    else:
                        last.append(_OTHER + ord(ch))
                        size.append(1)
                        forward.append(forward[d] + lowest)
                else:
                    best, i, length = lowest + forward[d], _OTHER + ord(ch), 1
                    if found and found[-1][0] == 1:
                        best = -1e300
                    for m, p in found:
                        f = forward[d + 1 - m] + score[p]
                        if f > best:
                            best, i, length = f, p, m
                    last.append(i)
                    size.append(length)
                    forward.append(best)
            out, d = [], n
            while d > 0:
                i = last[d]
                if i < _OTHER:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in reversed(chr(i - _OTHER).encode("utf-8", "replace"))]
                elif not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
                d -= size[d]
            out.reverse()
            before = word
            yield out

    def decode_word(self, ids) -> str:
        """The marked word of ids."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:  # bytes or unknowns
            return self._joined(ids)

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, unknowns the library's mark."""
        text = self._joined(ids).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def _joined(self, ids) -> str:
        parts, raw = [], bytearray()
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(" ⁇ " if i == self.unknown else self.text[i] if i in self.score else "")
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        return "".join(parts)


def pieces(path: str = MODEL) -> Pieces:
    return only_model(("pieces", path), lambda: Pieces(path))


def words_of(text: str) -> list[str]:
    """The words of a text without their first space mark; one that starts with a line feed has no mark."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " ":  # a leading space meets the mark in front
        return [w if w[0] == "\n" else w[1:] for w in _RUNS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def encode_texts(model: Pieces, texts: list) -> tuple[np.ndarray, np.ndarray, list]:
    """All ids of the texts, how many each has (none for a null or empty text), and whether decoding them gives the text (None for a null one).

    Decoding goes word by word: no character's bytes lie in two words, so a text is restored where all its words are."""
    split = [words_of(t) if t else [] for t in texts]
    words = list(set().union(*split))
    marked = [MARK + w.replace(" ", MARK) if w[:1] != "\n" else w for w in words]
    order = sorted(range(len(words)), key=marked.__getitem__)
    sizes, pool, place = np.empty(len(words), np.int64), [], {}
    good = np.empty(len(words), bool)
    decoded = model.decode_word
    for k, ids in zip(order, model.encode_sorted(map(marked.__getitem__, order))):
        place[words[k]] = len(place)
        sizes[len(place) - 1] = len(ids)
        good[len(place) - 1] = decoded(ids) == marked[k]
        pool += ids
    pool = np.array(pool, np.int32)
    starts = np.cumsum(sizes) - sizes
    out, counts = [], np.zeros(len(texts), np.int64)
    restored = [None if t is None else MARK not in t for t in texts]
    for i, ws in enumerate(split):
        if ws:
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            own = gathered(pool, starts[at], sizes[at])
            counts[i] = len(own)
            restored[i] = restored[i] and bool(good[at].all())
            out.append(own)
    return np.concatenate(out) if out else np.empty(0, np.int32), counts, restored


def encode(docs: DataFrame, path: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_ids, restored: one row per row of docs, in one pass without a shuffle. `restored` says whether decoding the ids gives the text.

    A null text has null ids, count and flag; an empty one no ids. The mark U+2581 in a text counts as a space, as in the library, so such a text isn't restored. Ids that are null
    or repeat are kept as they are; an empty table gives an empty one; other columns, whatever their names, aren't read. Every word of the text is encoded, however long.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        model = pieces(path)
        for b in regrouped(batches, 1):
            texts = b.column(1).to_pylist()
            gc.disable()  # millions of live strings and lists, none in cycles
            for i, j in slices(texts):
                ids, counts, restored = encode_texts(model, texts[i:j])
                offsets = np.concatenate(([0], np.cumsum(counts)))
                null = np.array([t is None for t in texts[i:j]], bool)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), lists, pa.array(counts.astype(np.int32), mask=null), pa.array(restored, pa.bool_())], names=["doc_id", "ids", "n_ids", "restored"]
                )

    return mapped(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, ids array<int>, n_ids int, restored boolean")


def decode(encoded: DataFrame, path: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text: the texts of id lists; null lists give null texts, empty ones empty texts, lists of any length their whole text. Ids that are null or repeat stay as they are; an empty table gives an empty one; other columns, whatever their names, aren't read."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches):
        model = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return mapped(encoded.select(F.col(doc_id), F.col(ids)), run, f"doc_id {kind}, text string")
