"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits. The trie of all fingerprints is built three times,
its bits rotated so that another third of them leads. With at most two
differing bits one third has none, so every link lies below some node at which
a leading third ends: the subtrees below those nodes are dealt out over the
cluster, and only a subtree's pair with itself is traversed, whatever its size.
The traversal goes down node pairs together, many subtrees side by side, adds up
the bits in which the two paths differ and drops a pair as soon as the budget is
exceeded.

A subtree with more than ``max_subtree`` fingerprints is not walked by one
task: its remaining bits are cut in thirds once more, with the same argument,
until every dealt subtree is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, forget, held, slices, with_few, written
from plumbline.llm.components import connected

SEED = 42
BITS = 64
#: Node pairs expanded at once, and rows of whole subtrees traversed at once; they bound the memory of a task.
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 1 << 20
#: No subtree of so few free bits that they name SMALL fingerprints at most is cut further.
SMALL = 1 << 18
ONE = np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half of the shingles' hashes have it.

    A-Z are lower-cased, words are split at ASCII white space. Fewer words than a
    shingle has: the whole sequence is the one shingle. No words (or null): zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts by blocks
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(1)):
                texts = b.column(1)[s.start : s.stop].cast(pa.binary()).to_pylist()
                fps = np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0)[s.start : s.stop], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")), run, "doc_id long, fp long")


def _spread(widths: list[int], parts: int) -> list[list[int]]:
    """Cuts free bits (counted as a list of positions) into near-equal runs."""
    edges = np.linspace(0, len(widths), parts + 1).round().astype(int)
    return [widths[a:b] for a, b in zip(edges, edges[1:])]


def _lead(positions: list[int]):
    """The bits at these positions of fp, next to each other, as a column."""
    runs: list[list[int]] = []
    for p in positions:
        if runs and runs[-1][-1] == p - 1:
            runs[-1].append(p)
        else:
            runs.append([p])
    value = F.lit(0).cast("long")
    for run in runs:
        mask = (1 << len(run)) - 1
        value = F.shiftleft(value, len(run)).bitwiseOR(F.shiftrightunsigned(F.col("fp"), BITS - 1 - run[-1]).bitwiseAND(F.lit(mask)))
    return value


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Number of bits of each 64-bit number; floats are exact for the halves."""
    high = x >> np.uint64(32)
    part = np.where(high > 0, high, x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.frexp(part)[1] + np.where(high > 0, 32, 0)


def trie_links(r: np.ndarray, roots: np.ndarray, budget: int, uniting) -> int:
    """Traverses the pair (root, root) of each root range of r together; each range is sorted, r as a whole needn't be.

    A node is a range of r whose keys share their bits up to the depth at which the range branches, and only such
    nodes are visited (paths without a branch are passed in one go). A pair of nodes carries the bits in which their
    paths differ so far and is dropped when these exceed the budget. Calls uniting(i, j) with arrays of positions that
    differ in budget bits at most; returns the number of node pairs visited.
    """
    roots = np.asarray(roots, np.int64).reshape(-1, 2)
    roots = roots[roots[:, 1] - roots[:, 0] > 1]
    zero = np.zeros(len(roots), np.int64)
    todo, visited = [np.column_stack((roots, roots, zero, zero))], 0

    def branch(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The depth at which a range branches; BITS for a single key."""
        return BITS - _bit_length(r[lo] ^ r[hi - 1])

    def cut(lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Where the child with a one begins in each range; its end if the range doesn't branch at that depth."""
        bit = ONE << (BITS - 1 - np.minimum(depth, BITS - 1)).astype(np.uint64)
        lo, hi = lo.copy(), hi.copy()
        while (ranges := lo < hi).any():
            middle = (lo + hi) >> 1
            one = (r[np.minimum(middle, len(r) - 1)] & bit) != 0
            hi = np.where(ranges & one, middle, hi)
            lo = np.where(ranges & ~one, middle + 1, lo)
        return lo

    while todo:
        front = todo.pop()
        if len(front) > PAIRS_AT_ONCE:
            todo += [front[k : k + PAIRS_AT_ONCE] for k in range(0, len(front), PAIRS_AT_ONCE)]
            continue
        visited += len(front)
        a0, a1, b0, b1, errors, depth = front.T
        of_a, of_b = branch(a0, a1), branch(b0, b1)
        to = np.minimum(of_a, of_b)
        below = np.where(depth > 0, (ONE << (BITS - np.maximum(depth, 1)).astype(np.uint64)) - ONE, ~np.uint64(0))
        rest = np.where(to < BITS, (ONE << (BITS - np.maximum(to, 1)).astype(np.uint64)) - ONE, np.uint64(0))
        rest = np.where(to > 0, rest, ~np.uint64(0))
        errors = errors + np.bitwise_count((r[a0] ^ r[b0]) & below & ~rest)
        near = errors <= budget
        a0, a1, b0, b1, errors, of_a, of_b, to = (x[near] for x in (a0, a1, b0, b1, errors, of_a, of_b, to))
        leaves = to == BITS
        if leaves.any():
            uniting(a0[leaves], b0[leaves])
            inner = ~leaves
            a0, a1, b0, b1, errors, of_a, of_b, to = (x[inner] for x in (a0, a1, b0, b1, errors, of_a, of_b, to))
        if not len(a0):
            continue
        same = a0 == b0
        am = np.where(of_a == to, cut(a0, a1, to), a1)
        bm = np.where(same, am, np.where(of_b == to, cut(b0, b1, to), b1))
        a_bit, b_bit = ((r[x] >> (BITS - 1 - to).astype(np.uint64)) & ONE for x in (a0, b0))  # of a node that doesn't branch
        children = []
        for i, (x0, x1) in enumerate(((a0, am), (am, a1))):
            for j, (y0, y1) in enumerate(((b0, bm), (bm, b1))):
                some = (x0 < x1) & (y0 < y1)
                some &= ~same | (i < j) | ((i == j) & (x1 - x0 > 1))  # of a node with itself, one of two mirror images
                x_bit, y_bit = np.where(of_a == to, i, a_bit), np.where(of_b == to, j, b_bit)
                now = errors + (x_bit != y_bit)
                some &= now <= budget
                children.append(np.column_stack((x0, x1, y0, y1, now, to + 1))[some])
        front = np.concatenate(children)
        if len(front):
            todo.append(front)
    return visited


class Forest:
    """Union by smallest position, for arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while True:
            a, b = up[i], up[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while True:
                over = up[up]
                if (over == up).all():
                    break
                up[:] = over


def _walk(max_bits: int):
    def found(trie: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """A spanning forest of the links within each whole subtree of sorted rows; all subtrees are traversed together."""
        new = np.flatnonzero(np.concatenate(([True], (trie[1:] != trie[:-1]) | (key[1:] != key[:-1]))))
        forest, r = Forest(len(fp)), fp.view(np.uint64)
        trie_links(r, np.column_stack((new, np.append(new[1:], len(fp)))), max_bits, forest.unite)
        child = np.flatnonzero(forest.up != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[forest.up[child]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if len(b):
                held.append([c.to_numpy() for c in b.columns])
            if sum(len(h[0]) for h in held) >= ROWS_AT_ONCE:
                whole = [np.concatenate(x) for x in zip(*held)]
                last = np.flatnonzero((whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]))[0]  # the last subtree may go on
                if last:
                    yield found(*(x[:last] for x in whole))
                held = [[x[last:] for x in whole]]
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(fps: DataFrame, max_bits: int = 2, max_subtree: int = 1 << 18) -> DataFrame:
    """(u, v) of distinct fingerprints: a spanning forest of all pairs at max_bits differing bits or fewer, per subtree.

    fps: one column fp of distinct fingerprints.
    """
    parts = max_bits + 1

    def ways(name: int, lead: list[int], free: list[int]) -> list[tuple[int, list[int], list[int]]]:
        """The tries that lead with a further part of the free bits: number, leading bits, free bits."""
        return [(name * parts + k, lead + more, [p for p in free if p not in more]) for k, more in enumerate(_spread(free, parts))]

    def dealt(df: DataFrame, found: list[tuple[int | None, list[tuple[int, list[int], list[int]]]]]) -> DataFrame:
        """(trie, key, fp) of the rows of each trie (None: of all) in its further tries."""
        each = [F.when(F.lit(True) if of is None else F.col("trie") == of, F.struct(F.lit(n).cast("long").alias("trie"), _lead(lead).alias("key"))) for of, own in found for n, lead, _ in own]
        return df.select("fp", F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))

    tries = {n: (lead, free) for n, lead, free in ways(1, [], list(range(BITS)))}
    rows = written(dealt(fps.select("fp"), [(None, [(n, *t) for n, t in tries.items()])]), "trie-rows")
    ready = None
    while True:
        large = rows.groupBy("trie", "key").count().where(F.col("count") > max_subtree).drop("count")
        hot_tries = []
        if 1 << min(len(free) for _, free in tries.values()) > SMALL:  # else no subtree is larger than that
            large = written(large, "trie-large")  # few: each holds over max_subtree fingerprints
            hot_tries = sorted(r["trie"] for r in large.select("trie").distinct().collect())  # as many as there are tries
        if not hot_tries:
            ready = rows if ready is None else ready.unionByName(rows)
            break
        small = rows.join(large, ["trie", "key"], "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        deeper = [(n, ways(n, *tries[n])) for n in hot_tries]
        rows = written(dealt(rows.join(large, ["trie", "key"], "left_semi"), deeper), "trie-rows")
        tries = {n: (lead, free) for _, own in deeper for n, lead, free in own}
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    own = ready.select("trie", "key", "fp").repartition("trie", "key").sortWithinPartitions("trie", "key", unsigned)
    return arrow_map(own, _walk(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, *, text: str = "text", shingle: int = 3, max_bits: int = 2, max_subtree: int = 1 << 18) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable over links.

    docs needs doc_id and the text column; other columns are not read. Null, empty and blank texts have
    fingerprint zero and link like any other. Rows with a null doc_id keep a row; a component of such rows alone
    has a null id. Repeated rows return as often as they stand. An empty table gives an empty result. A text of any
    length is hashed whole, shingles by blocks. Extra columns, whatever their names, play no part.
    """
    fps = written(fingerprints(docs, text, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = written(links(nodes.select("fp"), max_bits, max_subtree), "simhash-links")
    labels = connected(edges).select(F.col("node").alias("fp"), "root")
    linked = nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = written(linked, "simhash-nodes")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(linked.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2(docs: DataFrame) -> DataFrame:
    """Rows of op2_simhash_near_dup: the fingerprint as 16 hex digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, more: DataFrame | None = None, **options) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id; columns stay as they are.

    Rows that share a doc_id are one document, and one of them stays. Rows without a doc_id go. more: further links
    (u, v) of doc_ids; documents are then one group if links of either kind join them. Null, empty and blank texts are
    copies of each other. Columns may have any names; an empty table stays empty.
    """
    spark, mark = docs.sparkSession, held()
    found = written(near_duplicates(docs, **options).where("doc_id IS NOT NULL"), "simhash-found")
    forget(spark, mark, found)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct()
    if more is not None:
        roots = connected(found.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).unionByName(more))
        dropped = roots.where("node <> root").select(F.col("node").alias("_other")).distinct()
    dropped = with_few(written(dropped, "simhash-dropped"))
    own = docs.where("doc_id IS NOT NULL")
    own = own.join(dropped, own["doc_id"] == dropped["_other"], "left_anti")
    again = written(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "simhash-again")
    forget(spark, mark, dropped, again)
    if again.isEmpty():
        return own
    again = with_few(again)
    shared = own["doc_id"] == again["_again"]
    return own.join(again, shared, "left_anti").unionByName(own.join(again, shared, "left_semi").dropDuplicates(["doc_id"]))
