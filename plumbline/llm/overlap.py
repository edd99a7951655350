"""Pairs of texts by the exact Jaccard similarity of their word shingles.

Prefix filter: shingles have one order over all texts. Of n shingles the first n - ceil(t n) + 1 are a text's prefix,
and texts of similarity t or more share one of their prefixes at least, whatever the order is. Shingles that a sample of
the texts shows to be common come last, so few texts meet by them; the sample has an effect on cost only. Of two similar
texts, the smaller one meets the other within the first n - ceil(2 t n / (1 + t)) + 1 of its shingles (Xiao et al., 2008),
so only such rows look for partners, among the larger texts that have the shingle, and shingles without such a row
are left out. Pairs that meet and can still reach t by their sizes and positions are compared by bitmaps - each bit is the
parity of the shingles that hash to it, so two sets differ in at least as many shingles as their bitmaps in bits (Sandes et
al., 2020) - then by their prefixes, which have to share what the rest of the sets can't, and then counted out on their
whole sets: none is lost or guessed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, forget, held, slices, with_few, written
from plumbline.llm.components import connected

SIMILAR, SHINGLE = 0.8, 5
#: Texts sampled for common shingles, and how many of these are kept; sent to the workers.
SAMPLED, COMMON = 5_000, 50_000
#: Texts that meet by a shingle are all paired up to this number; beyond, most are linked by a few pairs first.
FEW = 32
#: Rows of a shingle's group that are compared with as many others in one go; a size class of a group has MOST blocks at most,
#: which are larger then, so a row stands in a bounded number of cells.
BLOCK, MOST = 2048, 16
#: Rows of cells that are dealt out at a time: so many a set, LEAST at least.
CELLS, LEAST = 8, 1 << 20
#: Pairs joined with their prefixes at a time, one for so many sets, and with their whole sets; the least numbers of either.
LED, LED_LEAST, WHOLE, WHOLE_LEAST = 4, 1 << 17, 16, 1 << 15
#: Rows of groups looked at together in a task, and 64-bit parts of a bitmap.
ROWS_AT_ONCE, LONGS = 1 << 20, 8
BITMAP = [f"b{i}" for i in range(LONGS)]
#: Rows of prefixes dealt out at a time, and into how many rounds at most; a round's shuffle goes before the next begins.
ROUND_ROWS, ROUNDS = 1 << 24, 4
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, shingle: int = SHINGLE, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes; words as in simhash.fingerprint, no words: empty."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * MIX[0] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _by_text(docs: DataFrame, made, schema: str) -> DataFrame:
    """Rows of (doc_id, text) with words, as made(ids, shingle sets) gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            for s in slices(b.column(1), 1_000_000):
                if len(known) > 100_000:
                    known.clear()
                found = [shingles(x, made.shingle, known) for x in b.column(1)[s.start : s.stop].cast(pa.binary()).to_pylist()]
                some = [i for i, x in enumerate(found) if len(x)]
                if some:
                    yield made(b.column(0)[s.start : s.stop].take(pa.array(some)), [found[i] for i in some])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts).view(np.int64)))


def _keys(found: list[np.ndarray]) -> pa.Array:
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(h.tobytes()) for h in found), np.uint64, len(found)).view(np.int64))


@dataclass(frozen=True)
class _Sets:
    """(key, sh): the shingles, and a hash that tells sets apart."""

    shingle: int

    def __call__(self, ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_keys(found), _lists(found)], ["key", "sh"])


@dataclass(frozen=True)
class _Sketches:
    """(doc_id, key, n, b0, ..., prefix): the set's hash, the number of shingles, the bitmap, the prefix.

    common: common shingles, the less common first.
    """

    shingle: int
    similar: float
    common: np.ndarray

    def __call__(self, ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        by = np.argsort(self.common)
        ordered, bits, first = self.common[by], [], []
        for h in found:
            bits.append(np.packbits((np.bincount((h >> np.uint64(7)).astype(np.int64) & (64 * LONGS - 1), minlength=64 * LONGS) & 1).astype(bool)).view(np.int64))
            own = h.view(np.int64)
            rank = np.zeros(len(h), np.int64)
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
                rank = np.where(ordered[at] == own, by[at] + 1, 0)
            first.append(own[np.lexsort((own, rank))[: len(h) - int(least(np.array(len(h)), self.similar)) + 1]])
        n = np.fromiter(map(len, found), np.int64, len(found))
        cols = [ids, _keys(found), pa.array(n), *(pa.array(x) for x in np.stack(bits, axis=1)), _lists(first)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", *BITMAP, "prefix"])


def least(n: np.ndarray, similar: float) -> np.ndarray:
    """The smallest whole number that is similar * n or more."""
    return np.ceil(similar * n - 1e-9).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], int | None]]:
    """The columns of groups (rows are sorted by the first column), about ROWS_AT_ONCE rows at a time.

    A group of more than FEW rows may be cut; then comes the key of the group that the piece goes on with.
    """
    held: list[list[np.ndarray]] = []
    going = None
    for b in batches:
        if len(b):
            held.append([c.to_numpy() for c in b.columns])
        if sum(len(h[0]) for h in held) >= ROWS_AT_ONCE:
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # where the last group begins; it may go on
            if len(whole[0]) - cut > FEW or whole[0][-1] == going:
                yield whole, going
                going, held = whole[0][-1], []
            elif cut:
                yield [x[:cut] for x in whole], going
                going, held = None, [[x[cut:] for x in whole]]
            else:
                held = [whole]
    if held:
        yield [np.concatenate(x) for x in zip(*held)], going


def _meetings(similar: float):
    """Pairs of sets that meet by a shingle and may be similar; rows (s, key, n, pos, p0, p1) are sorted by it.

    All pairs of groups of FEW rows or fewer; of a larger group a few a row, and its rows themselves. p0 and p1 are a set's
    first shingles. Two sets that share one of these met in its group, under weaker conditions - all pairs of a small group
    are there, and a large one's rows are all compared later - so later groups leave them to it, and most pairs come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, key, n, pos, *heads), going in _pieces(batches):
            order = np.lexsort((key, n, s))
            s, key, n, pos, *heads = (x[order] for x in (s, key, n, pos, *heads))
            new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            ends = np.append(new[1:], len(s))
            size, start, end = (np.repeat(x, ends - new) for x in (ends - new, new, ends))
            looks = _looks(n, pos, similar)
            worth = np.repeat(np.add.reduceat(looks, new) > 0, ends - new)
            large = (size > FEW) | (s == going if going is not None else False)
            kept: list[np.ndarray] = []

            def take(i: np.ndarray, j: np.ndarray) -> None:
                ok = (key[i] != key[j]) & _may(n[i], pos[i], n[j], pos[j], similar)
                for x, p in enumerate(heads):
                    for y, q in enumerate(heads):
                        ok &= (p[i] != q[j]) | (pos[i] <= x) | (pos[j] <= y)
                if ok.any():
                    kept.append(_ordered(key[i[ok]], key[j[ok]]))

            near, step = np.flatnonzero((size > 1) & looks & ~large), 1
            while len(near):  # sets of a group by size: once a set is too large for one, so are those behind it
                near = near[near + step < end[near]]
                near = near[n[near] >= similar * n[near + step] - 1e-9]
                take(near, near + step)
                step += 1
            rows = np.flatnonzero(large)
            looking = rows[looks[rows]]
            for turn in range(3):  # the next in size, and others of its group that differ from shingle to shingle
                other = mixed(key[looking].view(np.uint64) ^ s[looking].view(np.uint64) ^ np.uint64(turn)) % size[looking].astype(np.uint64)
                take(looking, np.where(turn == 0, np.minimum(looking + 1, end[looking] - 1), start[looking] + other.astype(np.int64)))
            rows = rows[worth[rows] | (s[rows] == s[0]) | (s[rows] == s[-1])]  # a group at the edge may look elsewhere
            pairs = np.unique(np.concatenate(kept), axis=0) if kept else np.zeros((0, 2), np.int64)
            some, none = len(pairs), len(rows)
            cols = [pa.array(np.concatenate((x, np.zeros(none, np.int64))), mask=np.arange(some + none) >= some) for x in pairs.T]
            cols += [pa.array(np.concatenate((np.zeros(some, np.int64), x[rows])), mask=np.arange(some + none) < some) for x in (s, key, n, pos)]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "s", "key", "n", "pos"])

    return run


def _looks(n: np.ndarray, pos: np.ndarray, similar: float) -> np.ndarray:
    """Whether a set can meet a larger one at a position."""
    return n - pos >= np.ceil(2 * similar / (1 + similar) * n - 1e-9)


def _may(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similar: float) -> np.ndarray:
    """Whether sets of n and m shingles that meet at positions at and to can be similar, by sizes and what is left."""
    need = np.ceil((n + m) * similar / (1 + similar) - 1e-9)
    return (np.minimum(n - at, m - to) >= need) & (np.minimum(n, m) >= similar * np.maximum(n, m) - 1e-9)


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0)


def _cells(similar: float):
    """(a, b) of each cell's pairs of different components that can be similar by sizes, positions and bitmaps.

    Rows (cell, side, key, n, pos, comp, bitmap) are sorted by cell. Sides 0 and 1 meet each other, 2 is met by all of
    itself. A cell has about two BLOCKs of rows; nothing but what passes the bitmaps leaves it.
    """

    def pairs(c: list[np.ndarray]) -> np.ndarray:
        side, key, n, pos, comp = c[1:6]
        bits = np.stack(c[6:], axis=1).view(np.uint64)
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found = []
        for at in range(0, len(first), ROWS_AT_ONCE // max(1, LONGS * len(second)) or 1):
            i = first[at : at + (ROWS_AT_ONCE // max(1, LONGS * len(second)) or 1)]
            j = second
            x, y = i[:, None], j[None, :]
            ok = (comp[x] != comp[y]) & _may(n[x], pos[x], n[y], pos[y], similar)
            ok &= np.where(n[x] <= n[y], _looks(n, pos, similar)[x], _looks(n, pos, similar)[y])
            ok &= ~((side[x] == 2) & (side[y] == 2)) | (x < y)
            a, b = np.nonzero(ok)
            if len(a):
                a, b = i[a], j[b]
                differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                near = differ <= (1 - similar) / (1 + similar) * (n[a] + n[b]) + 1e-9
                found.append(_ordered(key[a[near]], key[b[near]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            c = [x.to_numpy() for x in b.columns]
            cuts = [0, *(np.flatnonzero(np.diff(c[0])) + 1).tolist(), len(b)] if len(b) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and held[-1][0][0] != c[0][lo]:
                    got = pairs([np.concatenate(x) for x in zip(*held)])
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got.T], ["a", "b"])
                held.append([x[lo:hi] for x in c])
        if held:
            got = pairs([np.concatenate(x) for x in zip(*held)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got.T], ["a", "b"])

    return run


def meeting_pairs(rows: DataFrame, own: DataFrame, similar: float) -> DataFrame:
    """(a, b) of sets of different components that meet by a shingle and may be similar; whatever a group's size is.

    rows: (s, key, n, pos, comp), a written table; own: (key, bitmap). A group is cut into size classes, of which only the
    same and neighbours can be similar, and these by a hash into blocks of about BLOCK rows; each two blocks that can hold a
    pair are a cell of their own, so a group of very many rows is work of many tasks and none holds it. A row is copied to
    each cell of its block, so cells are dealt out in rounds, and a round's shuffle goes before the next begins.
    """
    classed = rows.withColumn("c", F.floor(F.log("n") / F.lit(float(np.log(1 / similar)) * (1 + 1e-9))).cast("int"))
    blocks = written(classed.groupBy("s", "c").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(MOST)).cast("int").alias("blocks")), "overlap-blocks")
    near = lambda d, name: blocks.select("s", (F.col("c") + d).alias("c"), F.col("blocks").alias(name))
    met = classed.join(near(0, "same"), ["s", "c"]).join(near(-1, "up"), ["s", "c"], "left").join(near(1, "down"), ["s", "c"], "left")
    met = met.join(own.select("key", *BITMAP), "key").withColumn("b", F.pmod(F.xxhash64("key"), F.col("same")).cast("int"))
    met = written(met, "overlap-met")
    n_rows = met.agg(F.sum(F.col("same") + F.coalesce("up", F.lit(0)) + F.coalesce("down", F.lit(0)))).first()[0] or 0
    rounds = -(-n_rows // max(LEAST, CELLS * own.count())) or 1
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda c1, b1, c2, b2, side: F.struct(F.xxhash64("s", c1, b1, c2, b2).alias("cell"), side.cast("long").alias("side"))
    c, b = F.col("c"), F.col("b")
    cells = F.concat(
        F.transform(up_to("same"), lambda o: cell(c, F.least(b, o), c, F.greatest(b, o), F.when(b == o, 2).when(b < o, 0).otherwise(1))),
        F.transform(up_to("up"), lambda o: cell(c, b, c + 1, o, F.lit(0))),
        F.transform(up_to("down"), lambda o: cell(c - 1, o, c, b, F.lit(1))),
    )

    def compared(r: int) -> DataFrame:
        own_turn = F.filter(cells, lambda x: F.pmod(x["cell"], F.lit(rounds)) == r)
        dealt = met.select(F.explode(own_turn).alias("x"), "key", "n", "pos", "comp", *BITMAP).select("x.cell", "x.side", "key", "n", "pos", "comp", *BITMAP)
        return written(arrow_map(dealt.repartition("cell").sortWithinPartitions("cell"), _cells(similar), "a long, b long"), "overlap-compared")

    return reduce(DataFrame.unionByName, [compared(r) for r in range(rounds)])


def similar_texts(docs: DataFrame, *, similar: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """(u, v) of doc_ids: they join all rows of docs whose sets of shingles have that Jaccard similarity, directly or over others.

    Rows without words or doc_id have no part. Rows that share a doc_id are each looked at, and their links are its links;
    equal texts are linked as copies. Texts of any length have all their shingles looked at; a text of fewer words than a
    shingle is one shingle. Without a row there is no link. Extra columns, whatever their names, play no part. Sets are told
    apart by 64 bits, and so are shingles. Intermediate tables go as soon as nothing reads them any more.
    """
    spark, mark = docs.sparkSession, held()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    share = max(1, docs.count() // SAMPLED)
    sample = _by_text(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(2 * SAMPLED), _Sets(shingle), "key long, sh array<long>").dropDuplicates(["key"])
    often = sample.select(F.explode("sh").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON)
    common = np.array([r["s"] for r in often.collect()][::-1], np.int64)
    found = _by_text(docs, _Sketches(shingle, similar, common), f"doc_id long, key long, n long, {', '.join(f'{b} long' for b in BITMAP)}, prefix array<long>")
    found = written(found, "overlap-sketches")
    own = written(found.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", *BITMAP, "prefix"))), "overlap-keys")
    ids = own.select("key", "least")
    copies = found.select(F.col("doc_id").alias("u"), "key").join(ids, "key").where("u <> least").select("u", F.col("least").alias("v"))
    copies = written(copies.distinct(), "overlap-copies")
    forget(spark, mark, own, copies)

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.select("s", "key", "n", "pos", "p0", "p1").repartition("s").sortWithinPartitions("s")
        return arrow_map(rows, _meetings(similar), "a long, b long, s long, key long, n long, pos long")

    n_sets = own.count()

    def in_turns(pairs: DataFrame, size: int, made, name: str) -> list[DataFrame]:
        """made(pairs), written, about size pairs at a time: what a turn shuffles, long lists a pair, goes before the next."""
        turns = -(-pairs.count() // size) or 1
        return [written(made(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == r)), name) for r in range(turns)]

    def checked(pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs that are similar, a written table."""
        before = held()
        side = lambda p: own.select(F.col("key").alias(p), F.col("least").alias(f"{p}_doc"), F.col("n").alias(f"{p}_n"), *(F.col(b).alias(f"{p}_{b}") for b in BITMAP))
        differ = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITMAP), F.lit(0))
        may = differ <= F.lit((1 - similar) / (1 + similar)) * (F.col("a_n") + F.col("b_n")) + F.lit(1e-9)
        pairs = written(pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b", "a_doc", "b_doc", "a_n", "b_n"), "overlap-near")
        looked_at = with_few(written(pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct(), "overlap-near-keys"))
        first = own.select("key", "prefix").join(looked_at, F.col("key") == F.col("_key"), "left_semi")

        def led(some: DataFrame) -> DataFrame:
            both = some.join(first.select(F.col("key").alias("a"), F.col("prefix").alias("p")), "a").join(first.select(F.col("key").alias("b"), F.col("prefix").alias("q")), "b")
            return both.where(F.size(F.array_intersect("p", "q")) >= both_need - rest).select("a", "b", "a_doc", "b_doc")

        both_need = F.ceil((F.col("a_n") + F.col("b_n")) * F.lit(similar / (1 + similar)) - F.lit(1e-9))
        rest = F.greatest(F.col("a_n") - F.size("p"), F.col("b_n") - F.size("q"))  # of the set whose prefix ends first, what may be shared beyond it
        pairs = reduce(DataFrame.unionByName, in_turns(pairs, max(LED_LEAST, n_sets // LED), led, "overlap-pairs"))
        ids = with_few(written(pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("id")).distinct(), "overlap-ids"))
        sets = _by_text(docs.join(ids, docs["doc_id"] == ids["id"], "left_semi"), _Sets(shingle), "key long, sh array<long>")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        one = written(sets.join(wanted, "key", "left_semi").dropDuplicates(["key"]), "overlap-one")
        alike = F.size(F.array_intersect("x", "y")) * F.lit(1 + similar) >= F.lit(similar) * (F.size("x") + F.size("y")) - F.lit(1e-9)

        def counted(some: DataFrame) -> DataFrame:
            both = some.join(one.select(F.col("key").alias("a"), F.col("sh").alias("x")), "a").join(one.select(F.col("key").alias("b"), F.col("sh").alias("y")), "b")
            return both.where(alike).select(F.col("a").alias("u"), F.col("b").alias("v"))

        links = in_turns(pairs, max(WHOLE_LEAST, n_sets // WHOLE), counted, "overlap-links")
        forget(spark, before, *links)
        return reduce(DataFrame.unionByName, links)

    heads = [F.coalesce(F.get("prefix", F.lit(k)), F.lit(0).cast("long")).alias(f"p{k}") for k in (0, 1)]
    rows = own.select("key", "n", *heads, F.posexplode("prefix").alias("pos", "s")).withColumn("pos", F.col("pos").cast("long"))
    n_rows = own.agg(F.sum(F.col("n") - F.ceil(F.col("n") * F.lit(similar) - F.lit(1e-9)) + 1)).first()[0] or 0
    rounds = min(ROUNDS, -(-int(n_rows) // ROUND_ROWS)) or 1
    dealt_out = [written(dealt(rows.where(F.pmod("s", F.lit(rounds)) == r)), "overlap-first") for r in range(rounds)]
    first = reduce(DataFrame.unionByName, dealt_out)
    links = checked(first.where("a IS NOT NULL").select("a", "b"))
    labels = connected(links).select(F.col("node").alias("key"), "root")
    large = first.where("s IS NOT NULL").select("s", "key", "n", "pos").join(labels, "key", "left")
    large = written(large.select("s", "key", "n", "pos", F.coalesce("root", "key").alias("comp")), "overlap-rest")
    mixed_groups = large.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("s")
    rest = meeting_pairs(large.join(mixed_groups, "s", "left_semi"), own, similar)
    links = links.unionByName(checked(rest))
    out = links.join(ids.select(F.col("key").alias("u"), F.col("least").alias("lu")), "u").join(ids.select(F.col("key").alias("v"), F.col("least").alias("lv")), "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    out = written(out.unionByName(copies).distinct(), "overlap-texts")
    forget(spark, mark, out)
    return out
