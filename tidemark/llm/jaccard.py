"""Exact Jaccard join of documents on word shingles, and the classes it links.

The distance 1 - J is a metric, and the join works on regions of documents that can
be within its radius of one another.  Width and similarity are parameters; the steps
are told for J >= 0.9:

1. Equal sets are one node, led by the smallest id.
2. Two sets at J >= 0.9 differ in at most h = (|A| + |B|) / 19 shingles.  The shingle
   universe is dealt into h + 3 buckets by hash, so at least three buckets agree
   entirely.  Sets that agree in a bucket (within one range of sizes) are neighbours,
   and the components of that relation are the first regions: no link leaves one.
   Below 0.9 buckets are so small that texts with a line in common agree in one.  There
   the universe is dealt into h + h / 3 buckets, so that a third of h agree, and only by
   the rarest of its agreeing buckets, up to where that many are left, is a set linked
   (``rarest``).
3. A region of more than ``CELL`` sets is cut by pivots: each set goes to the Voronoi cell
   of its nearest pivot and, by the triangle inequality, also to each cell whose pivot
   is at most twice the radius farther.  Sets that link with a pivot are linked there and
   need no comparison among themselves, so a cell of such sets only is done.  This recurs on
   cells that are still too large.  Where the windows overlap so much that cutting does not
   help, the cell is joined as pairs of blocks of its sets, without those of two blocks that
   link with one pivot; that is exact for any data and bounded in memory.
4. Each cell is joined exactly from the sizes of all intersections, and gives a spanning
   forest of its links.  The components of the forests are the classes.

Regions start from agreeing buckets instead of pivots over all documents, because texts
that are not copies are nearly all at a distance close to 1 from any pivot: the windows of
step 3 would put every one of them into every cell.

Shingles are 64-bit hashes.  Within one join two different shingles share a hash with a
chance of about pairs / 2**64.

Defined results: a null or empty text has an empty set and is a class of its own; a row
without an id has no class; rows with the same set share a class, so repeated rows do, and
rows that share an id but not a text are judged each by its own text; an empty table gives
an empty result; other columns are never read.  Ids may be of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, space_words, table
from .components import connected_components

SHINGLE = 3
#: J >= NUMERATOR / DENOMINATOR links.
NUMERATOR, DENOMINATOR = 9, 10
CELL = 1000
#: Shingles that one cell may hold in all; a cell beyond is cut whatever its number of sets.
CELL_SHINGLES = 3_000_000
PIVOTS = 8
DEPTH = 2
#: A cut must leave the largest cell at most this share of what it was.
HELPS = 0.6
SPREAD = 1.35

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], hashes: dict, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words are one run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    width = min(width, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = mixed(s * M3 + h[i : len(h) - width + 1 + i])
    return np.unique(s)


def bounds(top: int = 1 << 40) -> tuple[int, ...]:
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * SPREAD)))
    return tuple(out)


BOUNDS = np.array(bounds())


def rare(num: int, den: int) -> bool:
    """Whether buckets are too small for one of them to link two sets."""
    return num * DENOMINATOR < den * NUMERATOR


def differences(largest: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """At most so many elements are in one of two linked sets only, both of at most ``largest``."""
    return 2 * largest * (den - num) // (den + num)


def bucketed(s: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[np.ndarray, int]]:
    """Hashes of the buckets by which a set finds the sets that may link with it.

    One item for each range of sizes; with a set of that range that it links with, it
    has at least the second number of hashes in common.
    """
    n = len(s)
    if not n:
        return []
    edges = BOUNDS
    own = c = int(np.searchsorted(edges, n, side="right")) - 1
    out = []
    while c == own or n * den // num >= edges[c]:
        h = differences(int(edges[c + 1]) - 1, num, den)
        if h:  # or else only equal sets link
            spare = max(3, h // 3) if rare(num, den) else 3
            k = h + spare
            m = mixed(s + np.uint64(c + 1))
            b = ((m >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            sums = np.zeros(k, np.uint64)
            np.add.at(sums, b, mixed(m))
            sizes = np.bincount(b.astype(np.int64), minlength=k)
            keep, need, bare = np.arange(k), 1, int((sizes == 0).sum())
            if bare < spare:
                keep, need = keep[sizes > 0], spare - bare
            out.append((mixed(sums[keep] + keep.astype(np.uint64) * M2 + np.full(1, c, np.uint64) * M3), need))
        c += 1
    return out


def signatures(s: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[g for g, _ in bucketed(s, num, den)]])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, width: int, *, sigs: bool = True) -> DataFrame:
    """(doc_id, t, n, k1, k2, sigs): id, hash of the text, set size, 128 bits that name the set, bucket hashes or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(space_words(t), hashes, width) for t in part.column(2).to_pylist()]
                keys = np.array([names(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(signed(np.ascontiguousarray(keys[:, 0]))),
                        pa.array(signed(np.ascontiguousarray(keys[:, 1]))),
                        lists([signatures(s) for s in sets]) if sigs else pa.nulls(len(sets), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "t", "n", "k1", "k2", "sigs"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "t", "text").mapInArrow(run, f"doc_id {id_type}, t bigint, n bigint, k1 bigint, k2 bigint, sigs array<bigint>")


def names(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return s.sum(dtype=np.uint64), mixed(s * M3).sum(dtype=np.uint64)


def rarest(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, sigs): for each set and range of sizes, the rarest of the hashes that other sets have too.

    Two sets that share ``need`` hashes share one of those that are left when, in one order of
    all hashes, each gives up its last ``need - 1``.  Hashes that no other set holds link nothing
    and go first, the others by the number of documents that hold them.  A set stands under its
    name k1 in place of an id, so that copies are one.  Within a slice the holders of a hash
    become one row; the others keep the order of the documents, in which they compress best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 4096):
                found = {}
                for t in part.column(0).to_pylist():
                    s = shingle_set(space_words(t), hashes, width)
                    if len(s):
                        found.setdefault(int(names(s)[0].view(np.int64)), s)
                runs = [(u, q << 40 | need, g) for u, s in found.items() for q, (g, need) in enumerate(bucketed(s, num, den))]
                if not runs:
                    continue
                sizes = [len(g) for _, _, g in runs]
                g = signed(np.concatenate([g for _, _, g in runs]))
                u, q = np.repeat([u for u, _, _ in runs], sizes), np.repeat([q for _, q, _ in runs], sizes)
                order = np.argsort(g, kind="stable")
                first = np.concatenate([[True], g[order][1:] != g[order][:-1]])
                at = np.flatnonzero(first)
                more = np.diff(np.append(at, len(g))) - 1
                alone, lead = np.sort(order[at[more == 0]]), order[at[more > 0]]
                ends = np.concatenate([np.zeros(len(alone) + 1, np.int64), np.cumsum(2 * more[more > 0])]).astype(np.int32)
                rest = np.stack([u[order[~first]], q[order[~first]]], 1).ravel()
                rows = np.concatenate([alone, lead])
                mask = pa.array(np.arange(len(rows)) < len(alone))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[rows]), pa.array(u[rows]), pa.array(q[rows]), pa.ListArray.from_arrays(pa.array(ends), pa.array(rest), mask=mask)],
                    names=["g", "u", "q", "more"],
                )

    rows = docs.select("text").mapInArrow(run, "g bigint, u bigint, q bigint, more array<bigint>")
    same = Window.partitionBy("g")
    holders = F.sum(F.expr("1 + coalesce(size(more) div 2, 0)")).over(same)
    several = F.max("more").over(same).isNotNull() | (F.min("u").over(same) != F.max("u").over(same))
    own = F.array(F.struct("u", "q"))
    others = F.expr("transform(sequence(0, size(more) - 2, 2), i -> struct(get(more, i) AS u, get(more, i + 1) AS q))")
    shared = rows.withColumn("holders", holders).withColumn("several", several).filter("several")
    each = shared.select("g", "holders", F.inline(F.when(F.col("more").isNull(), own).otherwise(F.concat(own, others))))
    kept = F.size("o") - F.col("q").bitwiseAND(F.lit((1 << 40) - 1)).cast("int") + 1
    return (
        each.groupBy("u", "q")
        .agg(F.sort_array(F.collect_set(F.struct("holders", "g"))).alias("o"))  # at most the hashes of one set
        .select(F.col("u").alias("node"), "o", kept.alias("kept"))
        .filter("kept > 0")
        .select("node", F.slice("o", F.lit(1), F.col("kept")).getField("g").alias("sigs"))
    )


def neighbours(sketch: DataFrame) -> DataFrame:
    """(u, v) from (node, sigs): each set and the smallest node with which it shares a bucket; a star for each bucket.

    Within an Arrow batch a bucket is first linked locally and sends one row on, so a
    bucket shared by a third of all sets still reaches its task as one row from each batch.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            sig = column.flatten().to_numpy(zero_copy_only=False)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            order = np.lexsort((ids, sig))
            sig, ids = sig[order], ids[order]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            lead = ids[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))] if len(sig) else ids
            linked = ~first & (ids != lead)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(first.sum(), bool), np.ones(linked.sum(), bool)])),
                    pa.array(np.concatenate([sig[first], signed(mixed(ids[linked].astype(np.uint64)))])),
                    pa.array(np.concatenate([ids[first], ids[linked]])),
                    pa.array(np.concatenate([ids[first], lead[linked]])),
                ],
                names=["done", "g", "u", "v"],
            )

    rows = sketch.select("node", "sigs").mapInArrow(local, "done boolean, g bigint, u bigint, v bigint")
    lead = F.first("v").over(Window.partitionBy("g", "done").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("lead", lead)
        .select("u", F.when(F.col("done"), F.col("v")).otherwise(F.col("lead")).alias("v"))
        .filter("u <> v")
        .distinct()
    )


def sets_of(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, n, s) of the sets in ``members`` (doc_id, t, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in slices(batch, 64):
                sets = [shingle_set(space_words(t), hashes, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), lists(sets)], names=["node", "n", "s"]
                )

    return docs.join(members, ["doc_id", "t"]).select("node", "text").mapInArrow(run, "node bigint, n bigint, s array<bigint>")


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def voronoi(cells: DataFrame, sizes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(cell, node, reach) for cells (cell, node): the pivots, as (d, child, near), in whose windows a set lies.

    ``child`` is the pivot's node, and ``near`` tells whether the two link.  A row pairs one set with
    one pivot, and a cell is dealt in parts of about ``CELL`` sets, each of which meets its pivots.
    """
    parts = sizes.select("cell", F.ceil(F.col("rows") / CELL).cast("long").alias("parts"))
    picks = cells.groupBy("cell").agg(*[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
    pivots = (
        picks.select("cell", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("child"))
        .join(sets.select(F.col("node").alias("child"), F.col("s").alias("p")), "child")
        .join(parts, "cell")
        .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "child", "p")
    )
    rows = cells.join(parts, "cell").select("cell", F.expr("pmod(xxhash64(node, 7), parts)").alias("part"), "node").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in (3, 4):
                column = batch.column(k)
                ends = column.offsets.to_numpy()
                sides.append((ends - ends[0], column.flatten().to_numpy(zero_copy_only=False)))
            (a, x), (b, y) = sides
            both = [intersection(x[a[i] : a[i + 1]], y[b[i] : b[i + 1]]) for i in range(batch.num_rows)]
            union = np.diff(a).astype(np.int64) + np.diff(b) - np.array(both, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(both, pa.int64()), pa.array(union, pa.int64())], names=["cell", "node", "child", "both", "all"]
            )

    met = rows.join(pivots, ["cell", "part"]).select("cell", "node", "child", "s", "p")
    met = met.mapInArrow(run, "cell bigint, node bigint, child bigint, both bigint, all bigint")
    seen = F.struct((1 - F.col("both") / F.col("all")).alias("d"), "child", (F.col("both") * den >= F.col("all") * num).alias("near"))
    reach = F.expr(f"filter(o, x -> x.d <= o[0].d + {2 * (1 - num / den) + 1e-9})")
    return met.groupBy("cell", "node").agg(F.sort_array(F.collect_list(seen)).alias("o")).select("cell", "node", reach.alias("reach"))  # PIVOTS at most


def blocks(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Cells (cell, node, cover) too large to join at once as pairs of blocks: (cell, node) with a cell for each pair.

    Sets that link with one pivot, their ``cover``, are not paired with one another.
    """
    half = CELL // 2
    n = F.ceil(F.greatest(F.count("*") / half, F.sum("n") / (CELL_SHINGLES / 2))).cast("long")
    own = cells.join(sets.select("node", "n"), "node").withColumn("g", F.coalesce("cover", F.lit(-1)))
    groups = cut(own.groupBy("cell", "g").agg(n.alias("blocks")))
    each = groups.select("cell", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    other = each.select("cell", F.col("g").alias("g2"), F.col("b").alias("b2"))
    pairs = each.join(other, "cell").filter("(g < g2 OR (g = g2 AND b <= b2 AND g = -1))").withColumn("pair", F.xxhash64("cell", "g", "b", "g2", "b2"))
    sides = pairs.select("cell", "pair", F.explode(F.array(F.struct("g", "b"), F.struct(F.col("g2").alias("g"), F.col("b2").alias("b")))).alias("side"))
    sides = sides.select("cell", "pair", "side.g", "side.b").distinct()
    placed = own.join(groups, ["cell", "g"]).select("cell", "g", F.expr("pmod(xxhash64(node, 99), blocks)").alias("b"), "node")
    return placed.join(sides, ["cell", "g", "b"]).select(F.col("pair").alias("cell"), "node")


def links_within(nodes: np.ndarray, sets: list[np.ndarray], num: int = NUMERATOR, den: int = DENOMINATOR) -> list[tuple[int, int]]:
    """A spanning forest, as (node, smallest node of its tree), of the links among some sets."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(starts, len(flat)))
    common = np.zeros((n, n), np.float32)
    heavy = np.flatnonzero(counts > max(16, n // 16))
    for at in range(0, len(heavy), 1024):  # shingles of many sets: a dense product
        ids = heavy[at : at + 1024]
        d = np.zeros((n, len(ids)), np.float32)
        for j, i in enumerate(ids):
            d[owner[starts[i] : starts[i] + counts[i]], j] = 1
        common += d @ d.T
    for c in np.unique(counts[(counts > 1) & (counts <= max(16, n // 16))]):  # shingles of few: their pairs
        ids = np.flatnonzero(counts == c)
        step = max(1, 4_000_000 // (c * c))
        for at in range(0, len(ids), step):
            rows = owner[starts[ids[at : at + step]][:, None] + np.arange(c)]
            pairs = (rows[:, :, None] * n + rows[:, None, :]).ravel()
            common += np.bincount(pairs, minlength=n * n).reshape(n, n).astype(np.float32)
    inter = common.astype(np.int64)
    linked = inter * den >= (sizes[:, None] + sizes[None, :] - inter) * num
    np.fill_diagonal(linked, True)
    by_rank = np.argsort(nodes, kind="stable")
    label = np.empty(n, np.int64)
    label[by_rank] = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1)
        low = np.minimum(low, low[by_rank[low]])  # and what the smallest so far can reach
        if (low == label).all():
            break
        label = low
    lead = nodes[by_rank[label]]
    return [(int(u), int(v)) for u, v in zip(nodes, lead) if u != v]


def join_cells(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): spanning forests of the links within each cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        found = links_within(pdf["node"].to_numpy(), [np.asarray(s, np.int64) for s in pdf["s"]], num, den)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return cells.join(sets, "node").groupBy("cell").applyInPandas(run, "u bigint, v bigint")


def labelled(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, t, n, copies, top): for each row its class's first (doc_id, t), null where it is alone."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    by_rank = rare(num, den)
    sketch = cut(sketches(docs, width, sigs=not by_rank))
    key = ["k1", "k2", "n"]
    named = sketch.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    leads = named.groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("lead"), F.count("*").alias("copies"))
    leads = cut(leads.withColumn("node", F.monotonically_increasing_id()))
    at = leads.select("lead.doc_id", "lead.t", "node")
    if by_rank:
        near = connected_components(neighbours(cut(rarest(docs.filter(F.col("doc_id").isNotNull()), width, num, den))))
        near = near.withColumnRenamed("node", "k1").join(leads.select("k1", "node"), "k1").select("node", "component")
    else:
        near = connected_components(neighbours(named.select("doc_id", "t", "sigs").join(at, ["doc_id", "t"])))
    cells = cut(near.select(F.col("component").alias("cell"), "node"))
    sets = cut(sets_of(docs, at.join(cells.select("node"), "node"), width).groupBy("node").agg(F.first("n").alias("n"), F.first("s").alias("s")))
    sized, links = sized_cells(cells, sets, num, den)
    joined = join_cells(sized, sets, num, den)
    found = connected_components(joined if links is None else joined.unionByName(links))
    with_lead = found.join(leads.select("node", "lead"), "node")
    tops = with_lead.groupBy("component").agg(F.min("lead").alias("top"))
    tops = found.join(tops, "component").select("node", "top")
    several = leads.join(tops, "node", "left").filter("copies > 1 OR top IS NOT NULL")
    several = several.select(*key, "copies", F.coalesce("top", "lead").alias("top"))
    return sketch.select("doc_id", "t", *key).join(several, key, "left").select(
        "doc_id", "t", "n", "copies", F.when(F.col("doc_id").isNotNull(), F.col("top")).alias("top")
    )


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row for each document row: doc_id, n_shingles, component_id; J >= num / den on runs of ``width`` words links."""
    found = labelled(docs, id_col, text_col, width, num, den)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top.doc_id", "doc_id").alias("component_id"))


def sized_cells(cells: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """The cells (cell, node) cut until each can be joined in one task, and the links found with pivots (u, v)."""
    lengths = sets.select("node", "n")
    large = (F.col("rows") > CELL) | (F.col("shingles") > CELL_SHINGLES)
    done, links, parts = None, None, cells.withColumn("cover", F.lit(None).cast("long"))

    def more(have: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if have is None else have.unionByName(new)

    for depth in range(DEPTH + 1):
        now = cut(parts.join(lengths, "node").groupBy("cell").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")))
        big = now.filter(large)
        done = more(done, parts.join(now.filter(~large).select("cell"), "cell", "left_semi").select("cell", "node"))
        if big.isEmpty():
            return done, links
        parts = cut(parts.join(big.select("cell"), "cell", "left_semi"))
        if depth == DEPTH:
            break
        reached = cut(voronoi(parts.select("cell", "node"), big, sets, num, den))
        met = reached.select("cell", "node", F.explode("reach").alias("o")).select("cell", "node", "o.child", "o.near")
        links = more(links, met.filter("near AND node <> child").select(F.col("node").alias("u"), F.col("child").alias("v")).distinct())
        # cells whose sets all link with the pivot are done
        open_cells = cut(met.groupBy("cell", "child").agg(F.count("*").alias("most"), F.count_if(~F.col("near")).alias("left")).filter("left > 0"))
        widest = open_cells.groupBy("cell").agg(F.max("most").alias("most"))
        helped = big.join(widest, "cell").filter(F.col("most") <= HELPS * F.col("rows")).select("cell")
        stuck = reached.join(widest, "cell", "left_semi").join(helped, "cell", "left_anti")
        cover = F.when(F.expr("reach[0].near"), F.expr("reach[0].child"))  # the nearest pivot links if any does
        done = done.unionByName(blocks(stuck.select("cell", "node", cover.alias("cover")), sets))
        met = met.join(open_cells.select("cell", "child"), ["cell", "child"], "left_semi").join(helped, "cell", "left_semi")
        parts = cut(met.select(F.xxhash64("cell", "child").alias("cell"), "node", F.when(F.col("near"), F.col("child")).alias("cover")))
    return done.unionByName(blocks(parts, sets)), links


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns.

    Of several texts of one class under the smallest id, the one with the smallest hash is kept; of
    rows equal in id and text, any one.  A row without an id or without words is kept.
    """
    found = cut(labelled(docs, id_col, text_col, width, num, den).filter("top IS NOT NULL"))
    leads = (F.col("doc_id") == F.col("top.doc_id")) & (F.col("t") == F.col("top.t"))
    mark = "tidemark jaccard text"
    at = [F.col("doc_id").alias(id_col), F.col("t").alias(mark)]
    gone = found.filter(~leads).select(*at).distinct()
    kept = docs.withColumn(mark, F.xxhash64(text_col)).join(gone, [id_col, mark], "left_anti")
    again = cut(found.filter(leads & (F.col("copies") > 1)).groupBy("doc_id", "t").count().filter("count > 1").select(*at))
    if not again.isEmpty():
        once = kept.join(again, [id_col, mark], "left_semi").dropDuplicates([id_col, mark])
        kept = kept.join(again, [id_col, mark], "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, x AS seen FROM (SELECT DISTINCT x FROM e) UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
