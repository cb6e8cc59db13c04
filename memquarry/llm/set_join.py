"""All pairs of sets whose Jaccard similarity reaches a threshold, without loss, at any size and skew.

Items are 48-bit hashes. Sets whose similarity is t share at least t n items, n the size of either. The join takes these steps.

1. Each task makes the sets of its rows, a chunk of rows at a time, and sends a chunk's distinct items, sorted, to the ranges of the item space. An item that several rows of a chunk hold is sent once with their
   number, so an item that all documents hold arrives once a chunk.
2. A range counts in how many rows each item is, and tells the chunks which of their items are shared and how often. Items of a single row can be in no intersection: they go, and only their number stays known.
3. Back at the chunk, a set that shares fewer than t n items has no partner and goes. The items of the others are put into one order for all sets, by how many rows hold them and then by hash.
4. Sets are the points of R-trees: their items are hashed into groups and counted by group, and two sets share at most the sum over the groups of the smaller count. Leaves are packed by the least hash among a set's usual
   items, so near copies lie together, and never only those: packing decides what is compared first, not what is found.
5. Two leaves are compared where they have a pair that the bound can't tell apart. For that, groups are single items in their common order: sets with J >= t share one among the first n - ceil(t n) + 1 items of each, and
   from a shared item on the sum of minima is at most what either has left; with the largest rest and the least size of a leaf the same bound holds for all its points.
6. A leaf meets all leaves that are to be compared with it, in blocks; the bound of sums of minima over the groups, on nodes and then on points, leaves the pairs that are verified on the sets.

Shuffled are seven bytes an item, the shared items again, and the sets that may have a partner. No list of partners or candidates is capped, no block holds more than a fixed number of sets of a leaf, equal sets are one set, and
nothing is collected. The result is exact but for collisions of 48-bit hashes, which change an overlap of two sets of 1,000 items with a probability of 4e-9.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import gathered, mapped, mix64, order_of, pack, regrouped, slices, unpack, written

BITS = 48
CHUNK_ROWS = 60_000
GROUPS, LEAF = 128, 16
BLOCK, VISITORS = 256, 1024
HOT = 20_000  # leaves with one item that a task compares; those of more are met in blocks of about as many
_SPREAD = 4  # ranges of items a partition takes one after another
_TIE = 1e-9


def ranges_of(spark) -> int:
    return _SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_starts(ranges: int) -> np.ndarray:
    """The least item of each of the ranges of equal width."""
    return (((np.arange(ranges, dtype=np.uint64) << np.uint64(32)) + np.uint64(ranges - 1)) // np.uint64(ranges)) << np.uint64(BITS - 32)


def _cuts(items: np.ndarray, ranges: int):
    """(range, its least item, start, stop) of sorted items, for ranges that hold any."""
    lows = range_starts(ranges)
    at = np.append(np.searchsorted(items, lows), len(items))
    return [(k, lows[k], int(at[k]), int(at[k + 1])) for k in np.flatnonzero(at[1:] > at[:-1]).tolist()]


def _steps(items: np.ndarray, low) -> np.ndarray:
    return np.diff(items, prepend=low)


def _by_range(rows: DataFrame, ranges: int) -> DataFrame:
    return rows.repartitionById(ranges // _SPREAD, F.expr(f"p div {_SPREAD}").cast("int")).sortWithinPartitions("p")


def grouped(batches, key: list[str]):
    """Of batches sorted by key: the key's values and the rows (dicts) of each group; one group is held at a time."""
    own, held = None, []
    for b in batches:
        names = b.schema.names
        for row in zip(*(c.to_pylist() for c in b.columns)):
            row = dict(zip(names, row))
            k = tuple(row[x] for x in key)
            if k != own:
                if held:
                    yield own, held
                own, held = k, []
            held.append(row)
    if held:
        yield own, held


def _spread(make, ranges: int, id_type):
    columns = {"p": pa.int32(), "chunk": pa.int64(), "kind": pa.int32(), "data": pa.binary(), "ids": pa.list_(id_type), "marks": pa.binary(), "sizes": pa.binary(), "rows": pa.binary()}

    def chunk_rows(chunk, ids, texts):
        items, sizes, marks = make(texts)
        order = order_of(items)
        g, row = items[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))) if len(g) else np.zeros(1, np.int64)
        count = np.diff(edge)
        alone, many = edge[:-1][count == 1], edge[:-1][count > 1]
        one, several, times = g[alone], g[many], count[count > 1]
        # the chunk's own record goes along through the same shuffles
        out = [(int(chunk % ranges), chunk, 0, pack(several, times), ids, b"".join(marks), pack(sizes), pack(row[np.repeat(count > 1, count)]))]
        none = (None,) * 4
        out += [(k, chunk, 1, pack(_steps(one[a:b], low), row[alone[a:b]]), *none) for k, low, a, b in _cuts(one, ranges)]
        out += [(k, chunk, 2, pack(_steps(several[a:b], low), times[a:b]), *none) for k, low, a, b in _cuts(several, ranges)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(columns.values())], names=list(columns))

    def run(batches):
        task, number = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for b in regrouped(batches, 1):
            texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in slices(texts):
                for k in range(i, j, CHUNK_ROWS):
                    stop = min(j, k + CHUNK_ROWS)
                    yield chunk_rows(task << 32 | number, ids[k:stop], texts[k:stop])
                    number += 1

    return run


def _counted(ranges: int):
    """Of each range's items those that several rows hold, for each chunk with the logarithm of their number."""
    lows = range_starts(ranges)
    names = ("p", "chunk", "kind", "data", "ids", "marks", "sizes", "rows")

    def answers(p, asked):
        columns = [unpack(r["data"]) for r in asked]
        sizes = [len(c[0]) for c in columns]
        g = np.concatenate([lows[p] + np.cumsum(c[0], dtype=np.uint64) for c in columns])
        other = np.concatenate([c[1] for c in columns])
        owner = np.repeat(np.arange(len(asked)), sizes)
        many = np.repeat([r["kind"] == 2 for r in asked], sizes)
        order = order_of(g)
        g, owner, many, other = g[order], owner[order], many[order], other[order]
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        held = np.add.reduceat(np.where(many, other, 1).astype(np.int64), start)
        held = np.repeat(held, np.diff(np.append(start, len(g))))
        at = np.flatnonzero(held > 1)
        at = at[np.argsort(owner[at].astype(np.int16 if len(asked) < 1 << 15 else np.int64), kind="stable")]
        g, owner, other, code = g[at], owner[at], other[at], np.minimum(255, 8 * np.log2(held[at])).astype(np.uint64)
        edge = np.searchsorted(owner, np.arange(len(asked) + 1))
        for k, r in enumerate(asked):
            a, b = edge[k], edge[k + 1]
            if a < b:
                yield (p, r["chunk"], r["kind"], pack(_steps(g[a:b], lows[p]), code[a:b], other[a:b]) if r["kind"] == 1 else pack(_steps(g[a:b], lows[p]), code[a:b]), None, None, None, None)

    def run(batches):
        for (p,), rows in grouped(batches, ["p"]):
            out = [tuple(r[n] for n in names) for r in rows if r["kind"] == 0]
            if asked := [r for r in rows if r["kind"]]:
                # items rise within each chunk, so the whole is a merge
                out += answers(p, asked)
            if out:
                yield out

    return run


def _kept(ranges: int, threshold: float):
    lows = range_starts(ranges)

    def chunk(rows):
        own = next(r for r in rows if r["kind"] == 0)
        (sizes,) = unpack(own["sizes"])
        n = sizes.astype(np.int64)
        several, times = unpack(own["data"])
        (holders,) = unpack(own["rows"])
        first = np.cumsum(times.astype(np.int64)) - times.astype(np.int64)
        doc, item, code = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for r in rows:
            if r["kind"] == 0:
                continue
            columns = unpack(r["data"])
            g = lows[r["p"]] + np.cumsum(columns[0], dtype=np.uint64)
            if r["kind"] == 1:
                doc.append(columns[2].astype(np.int64))
                item.append(g)
                code.append(columns[1])
            else:
                at = np.searchsorted(several, g)
                k = times[at].astype(np.int64)
                doc.append(gathered(holders, first[at], k).astype(np.int64))
                item.append(np.repeat(g, k))
                code.append(np.repeat(columns[1], k))
        doc, item, code = np.concatenate(doc), np.concatenate(item), np.concatenate(code)
        order = order_of(code << np.uint64(BITS) | item)
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
        doc, item, code = doc[order], item[order], code[order]
        shared = np.bincount(doc, minlength=len(n))
        ok = (shared >= threshold * n - _TIE) & (shared > 0)
        ends = np.cumsum(shared)
        begin = (ends - shared)[ok]
        stays = ok[doc]
        doc, item, code = doc[stays], item[stays], code[stays]
        shared = shared[ok]
        begin = np.cumsum(shared) - shared
        usual = np.repeat(code[begin + shared // 2], shared) + np.uint64(16) if len(begin) else code
        least = np.where(code <= usual, mix64(item + np.uint64(0x1B873593)), np.uint64(2**64 - 1))
        node = np.zeros(len(n), np.int64)
        if len(begin):
            node[ok] = np.minimum.reduceat(least, begin).view(np.int64)
        raw = np.ascontiguousarray(item, "<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
        blobs: list = [None] * len(n)
        for d, a, k in zip(np.flatnonzero(ok).tolist(), begin.tolist(), shared.tolist()):
            blobs[d] = raw[a : a + k].tobytes()
        marks = [own["marks"][16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]
        return own["ids"], marks, n.astype(np.int32), pa.array(node, mask=~ok), blobs

    return chunk


def items_of(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // (BITS // 8), 8), np.uint8)
    out[:, : BITS // 8] = np.frombuffer(blob, np.uint8).reshape(-1, BITS // 8)
    return out.view("<u8").reshape(-1)


def marks_of(items: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A 16-byte digest of each set; of an empty one b''."""
    data, ends = memoryview(np.ascontiguousarray(items).view(np.uint8)), np.cumsum(sizes) * 8
    return [hashlib.blake2b(data[e - 8 * s : e], digest_size=16).digest() if s else b"" for e, s in zip(ends.tolist(), sizes.tolist())]


def keyed(docs: DataFrame, make, threshold: float, name: str = "sets") -> DataFrame:
    """doc_id, mark, n, node, items: one row per row of docs (doc_id, text), written. `make` gives of texts the items (48 bits, sorted and distinct within a text, one text after another), how many each text has, and marks_of() them.

    mark is null of an empty set. node and items (in the common order, without those that no other row holds) are null unless the set shares enough items to have a partner at the threshold.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type, ranges = to_arrow_type(kind), ranges_of(docs.sparkSession)
    schema = f"p int, chunk long, kind int, data binary, ids array<{kind.simpleString()}>, marks binary, sizes binary, rows binary"
    sent = _by_range(mapped(docs.select("doc_id", "text"), _spread(make, ranges, id_type), schema), ranges)
    arrow = {"p": pa.int32(), "chunk": pa.int64(), "kind": pa.int32(), "data": pa.binary(), "ids": pa.list_(id_type), "marks": pa.binary(), "sizes": pa.binary(), "rows": pa.binary()}

    def count(batches):
        for out in _counted(ranges)(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow.values())], names=list(arrow))

    def keep(batches):
        chunk = _kept(ranges, threshold)
        for _, rows in grouped(batches, ["chunk"]):
            ids, marks, n, node, blobs = chunk(rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(marks, pa.binary()), pa.array(n), node, pa.array(blobs, pa.binary())], names=["doc_id", "mark", "n", "node", "items"])

    back = mapped(sent, count, schema).repartition(ranges // _SPREAD, "chunk").sortWithinPartitions("chunk")
    return written(mapped(back, keep, f"doc_id {kind.simpleString()}, mark binary, n int, node long, items binary"), name)


def _entries(ranges: int, threshold: float):
    """The items by which leaves may meet: of each set those from which on it has enough left; of each leaf and item the largest rest and the least size."""

    def run(batches):
        for b in regrouped(batches, 2, 16_000_000):
            blobs, n = b.column("items").to_pylist(), b.column("n").to_numpy().astype(np.int64)
            if not blobs:
                continue
            node = b.column("node").to_numpy().view(np.uint64)
            shared = np.array([len(x) for x in blobs], np.int64) // (BITS // 8)
            take = np.floor(shared - threshold * n + _TIE).astype(np.int64) + 1
            take = np.minimum(np.maximum(take, 0), shared)
            item = items_of(b"".join([x[: k * (BITS // 8)] for x, k in zip(blobs, take.tolist())]))
            own = np.repeat(np.arange(len(n)), take)
            rest = np.repeat(shared, take) - (np.arange(len(own)) - np.repeat(np.cumsum(take) - take, take))
            item, leaf, size, rest = _merged(item, node[own], n[own], rest)
            rows = [(k, pack(_steps(item[a:z], low), leaf[a:z], size[a:z], rest[a:z])) for k, low, a, z in _cuts(item, ranges)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["p", "data"])

    return run


def _merged(item, leaf, size, rest):
    """One entry per item and leaf, sorted by both."""
    order = np.lexsort((leaf, item))
    item, leaf, size, rest = item[order], leaf[order], size[order], rest[order]
    if not len(item):
        return item, leaf, size, rest
    start = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (leaf[1:] != leaf[:-1]))))
    return item[start], leaf[start], np.minimum.reduceat(size, start), np.maximum.reduceat(rest, start)


def _meetings(ranges: int, threshold: float, hot: int):
    """Pairs of leaves; entries of an item that more than `hot` leaves have are passed on instead, to be met in blocks."""
    lows, share = range_starts(ranges), threshold / (1 + threshold)

    def pairs(p, rows):
        columns = [unpack(r["data"]) for r in rows]
        item = np.concatenate([lows[p] + np.cumsum(c[0], dtype=np.uint64) for c in columns])
        item, leaf, size, rest = _merged(item, *(np.concatenate([c[k] for c in columns]).astype(t) for k, t in ((1, np.uint64), (2, np.int64), (3, np.int64))))
        start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        runs = np.diff(np.append(start, len(item)))
        if (many := np.repeat(runs > hot, runs)).any():
            yield item[many], leaf[many], size[many], rest[many]
            item, leaf, size, rest, runs = item[~many], leaf[~many], size[~many], rest[~many], runs[runs <= hot]
        stop = np.repeat(np.cumsum(runs), runs)
        i, step, found, count = np.arange(len(item)), 1, [], 0
        while True:  # each entry with the one `step` behind it, as long as items have that many
            i = i[i + step < stop[i]]
            if not len(i):
                break
            ok = np.minimum(rest[i], rest[i + step]) >= share * (size[i] + size[i + step]) - _TIE
            found.append(np.stack((leaf[i[ok]], leaf[i[ok] + step]), axis=1))
            count += len(found[-1])
            step += 1
            if count > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                yield from found
                found, count = [], 0
        if found:
            yield np.unique(np.concatenate(found), axis=0)

    def run(batches):
        for (p,), rows in grouped(batches, ["p"]):
            for found in pairs(p, rows):
                if isinstance(found, tuple):
                    item, leaf, size, rest = (x.astype(np.uint64).view(np.int64) for x in found)
                    columns = [pa.array(leaf), pa.nulls(len(leaf), pa.int64()), pa.array(item), pa.array(size), pa.array(rest)]
                else:
                    a, b = found.min(axis=1).view(np.int64), found.max(axis=1).view(np.int64)
                    columns = [pa.array(a), pa.array(b), *(pa.nulls(len(a), pa.int64()) for _ in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["node_a", "node_b", "item", "size", "rest"])

    return run


def _block_meetings(threshold: float):
    """The pairs of leaves of two blocks of one item's entries, or of one block."""
    share = threshold / (1 + threshold)

    def run(batches):
        for (_, bi, bj), rows in grouped(batches, ["item", "bi", "bj"]):
            leaf, size, rest, own = (np.array([r[k] for r in rows], np.int64) for k in ("node_a", "size", "rest", "own"))
            left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            for at in range(0, len(left), 1024):
                x = left[at : at + 1024]
                i, j = np.nonzero(np.minimum(rest[x][:, None], rest[right][None, :]) >= share * (size[x][:, None] + size[right][None, :]) - _TIE)
                a, b = leaf[x[i]], leaf[right[j]]
                a, b = (v[a != b] if bi != bj else v[a < b] for v in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.uint64), b.view(np.uint64)).view(np.int64)), pa.array(np.maximum(a.view(np.uint64), b.view(np.uint64)).view(np.int64))], names=["node_a", "node_b"])

    return run


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets], np.int32).reshape(len(sets), GROUPS)


class Tree:
    """An R-tree over points, packed by halving along the widest coordinate, to LEAF points a leaf. A node holds its points' largest counts and the least size of their sets (which may be larger than the counts' sum)."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.rows, self.most, self.least, self.kids = rows, own.max(axis=0), sizes[rows].min(), None
        if len(rows) > LEAF:
            order = rows[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
            self.kids = Tree(points, sizes, order[: len(order) // 2]), Tree(points, sizes, order[len(order) // 2 :])

    def joined(self, other: "Tree", points: np.ndarray, sizes: np.ndarray, share: float, out: list) -> None:
        """Adds to out the arrays (i, j) of all points of self and other that the bound can't tell apart."""
        stack = [(self, other)]
        while stack:
            a, b = stack.pop()
            if np.minimum(a.most, b.most).sum() < share * (a.least + b.least) - _TIE:
                continue
            if a.kids or b.kids:
                if a is b:
                    stack += [(a.kids[0], a.kids[0]), (a.kids[1], a.kids[1]), (a.kids[0], a.kids[1])]
                elif a.kids and (not b.kids or len(a.rows) >= len(b.rows)):
                    stack += [(kid, b) for kid in a.kids]
                else:
                    stack += [(a, kid) for kid in b.kids]
                continue
            x, y = points[a.rows], points[b.rows]
            shared = np.minimum(x[:, None, :], y[None, :, :]).sum(axis=2)
            i, j = np.nonzero(shared >= share * (sizes[a.rows][:, None] + sizes[b.rows][None, :]) - _TIE)
            if a is b:
                i, j = i[i < j], j[i < j]
            out.append((a.rows[i], b.rows[j]))


def candidates(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, both of left, or one of left and one of right, that the bound lets through."""
    out: list = []
    if len(left) and (right is None or len(right)):
        tree = Tree(points, sizes, left)
        tree.joined(tree if right is None else Tree(points, sizes, right), points, sizes, threshold / (1 + threshold), out)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of sorted distinct arrays."""
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def block_links(rows: list[dict], threshold: float) -> list[tuple]:
    """(mark_a, mark_b, jaccard) of one block: its own sets with one another where they are all of their leaf's (`whole`), and with the visitors. A leaf of several blocks visits itself; there a pair is taken once, by its marks' order."""
    sets = [np.sort(items_of(r["items"])) for r in rows]
    sizes, visits = np.array([r["n"] for r in rows], np.int64), np.array([r["visits"] for r in rows])
    points, home, guests = points_of(sets), np.flatnonzero(~visits), np.flatnonzero(visits)
    found = [candidates(points, sizes, home, guests, threshold)]
    if rows[0]["whole"]:
        found.append(candidates(points, sizes, home, None, threshold))
    out = []
    for i, j in found:
        for p, q in zip(i.tolist(), j.tolist()):
            a, b = rows[p], rows[q]
            if b["visits"] and b["own"] and a["mark"] >= b["mark"]:
                continue
            common = overlap(sets[p], sets[q])
            if (s := common / (a["n"] + b["n"] - common)) >= threshold:
                out.append((min(a["mark"], b["mark"]), max(a["mark"], b["mark"]), s))
    return out


def by_core(table: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """mark, core of the sets of keyed() that may have a partner; and mark, n, node, items of each core, which links() takes as a set. Both are written.

    A set's core is what another set can share with it and how many items it has: of two sets all that their similarity depends on. So sets of one core have the same links but for their own, and are one point of the join however many they are.
    keyed() counts rows; here items are counted again in different sets that may have a partner, so copies of a set, or sets without a partner, don't keep an item in the core.
    """
    wide = BITS // 8
    sets = table.where("items IS NOT NULL").groupBy("mark").agg(F.first(F.struct("n", "node", "items")).alias("s")).select("mark", "s.*")
    cut = F.transform(F.sequence(F.lit(0), (F.length("items") / wide).cast("int") - 1), lambda i: F.substring(F.col("items"), i * wide + 1, F.lit(wide)))
    cut = written(sets.where(F.length("items") > 0).select("mark", "n", "node", F.posexplode(cut).alias("at", "item")), "set-pieces")
    shared = cut.groupBy("item").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("item")
    left = cut.join(shared, "item").groupBy("mark").agg(F.first("n").alias("n"), F.first("node").alias("node"), F.array_sort(F.collect_list(F.struct("at", "item"))).alias("left"))
    left = left.where(F.size("left") >= threshold * F.col("n") - _TIE).select("mark", "n", "node", F.unhex(F.array_join(F.transform("left", lambda x: F.hex(x["item"])), "")).alias("items"))
    left = written(left.withColumn("core", F.unhex(F.md5(F.concat(F.encode(F.concat(F.col("n").cast("string"), F.lit(":")), "utf-8"), F.col("items"))))), "set-cores")
    cores = left.groupBy(F.col("core").alias("mark")).agg(F.first("n").alias("n"), F.min("node").alias("node"), F.first("items").alias("items"))
    return left.select("mark", "core"), written(cores, "cores")


def links(table: DataFrame, threshold: float) -> DataFrame:
    """mark_a < mark_b, jaccard: all pairs of different sets of keyed() that reach the threshold it was made with."""
    spark, ranges = table.sparkSession, ranges_of(table.sparkSession)
    sets = table.where("items IS NOT NULL").groupBy("mark").agg(F.first(F.struct("n", "node", "items")).alias("s")).select("mark", "s.*")
    sets = written(sets, "set-items")
    met = _by_range(mapped(sets.select("node", "n", "items"), _entries(ranges, threshold), "p int, data binary"), ranges)
    met = written(mapped(met, _meetings(ranges, threshold, HOT), "node_a long, node_b long, item long, size long, rest long"), "leaf-pairs")
    hot, met = met.where("item IS NOT NULL"), met.where("item IS NULL").select("node_a", "node_b")
    if not hot.isEmpty():
        parts = hot.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts"))
        placed = hot.join(parts, "item").withColumn("own", F.pmod(F.xxhash64("node_a"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = placed.select("item", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node_a", "size", "rest")
        placed = placed.repartition(ranges // _SPREAD, "item", "bi", "bj").sortWithinPartitions("item", "bi", "bj")
        met = met.unionByName(mapped(placed, _block_meetings(threshold), "node_a long, node_b long"))
    met = met.distinct()
    count = sets.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    pairs = met.join(count.toDF("node_a", "ca"), "node_a").join(count.toDF("node_b", "cb"), "node_b")
    larger = F.col("ca") >= F.col("cb")
    pairs = pairs.select(F.when(larger, F.col("node_a")).otherwise(F.col("node_b")).alias("home"), F.when(larger, F.col("node_b")).otherwise(F.col("node_a")).alias("guest"), F.least("ca", "cb").alias("v"))
    pairs = written(pairs, "visits")
    homes = count.toDF("home", "c").join(pairs.groupBy("home").agg(F.sum("v").alias("v")), "home", "left").select("home", "c", F.coalesce("v", F.lit(0)).alias("v")).where("c > 1 OR v > 0")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    homes = homes.select("home", blocks.alias("blocks"), F.ceil((F.col("v") + F.when(blocks > 1, F.col("c")).otherwise(0)) / VISITORS).cast("int").alias("parties"))
    homes = homes.select("home", "blocks", F.greatest("parties", F.lit(1)).alias("parties"))
    within = lambda n, salt: F.pmod(F.xxhash64("mark", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sets.withColumnRenamed("node", "home").join(homes, "home")
    hosts = own.withColumn("block", within("blocks", 1)).withColumn("party", every("parties")).withColumn("visits", F.lit(False)).withColumn("own", F.lit(True))
    selves = own.where("blocks > 1").withColumn("party", within("parties", 2)).withColumn("block", every("blocks")).withColumn("visits", F.lit(True)).withColumn("own", F.lit(True))
    guests = sets.withColumnRenamed("node", "guest").join(pairs.select("home", "guest").join(homes, "home"), "guest").withColumn("party", within("parties", 2)).withColumn("block", every("blocks")).withColumn("visits", F.lit(True)).withColumn("own", F.lit(False))
    columns = ["home", "block", "party", "mark", "n", "items", "visits", "own", ((F.col("blocks") == 1) & (F.col("party") == 0)).alias("whole")]
    rows = hosts.select(columns).unionByName(selves.select(columns)).unionByName(guests.select(columns))
    rows = rows.repartition(ranges // _SPREAD, "home", "block", "party").sortWithinPartitions("home", "block", "party")

    def verify(batches):
        for _, held in grouped(batches, ["home", "block", "party"]):
            found = block_links(held, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.float64())], names=["mark_a", "mark_b", "jaccard"])

    return mapped(rows, verify, "mark_a binary, mark_b binary, jaccard double")
