"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are runs of ``width`` consecutive benchmark words; an item with fewer
words, but at least one, is a single shorter pattern.  Symbols are words and a
block is two of them: the shift table, addressed by the hash of a block, says how far
the search window may jump when it ends in that block; a block with shift zero selects
the bucket of patterns with that suffix, and a comparison of all words confirms each
occurrence.  Patterns of equal length share one table, so a short item never shortens
the jumps of the others.

The benchmark reaches the executors as numpy tables of at most ``PATTERNS`` patterns (some
100 MB), however long its items are.  A larger benchmark takes several passes over the
documents; a pass writes the few texts it hits, and one table is alive at a time.  A pass is
row-local: no shuffle, whatever the skew.

Defined results: a null or empty text has no words and no hits; repeated rows are
judged each on its own; passages of items without an id are hits, and those items count as
one, which adds nothing to the digest; a benchmark without words marks nothing; columns
other than the id and the text are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, cut, slices, table

WIDTH = 10
PATTERNS = 1_000_000


class Automaton(NamedTuple):
    """Tables for the patterns of one length; words are numbers, -1 one that no pattern has."""

    length: int
    block: int
    shift: np.ndarray  # by the hash of a block
    suffix: np.ndarray  # the block at the end of each pattern, ascending
    patterns: np.ndarray  # distinct patterns, words from the last to the first, in that order
    first: np.ndarray  # where each pattern's items begin in ``items``
    items: np.ndarray  # places in the list of item ids


class Tables(NamedTuple):
    words: dict
    names: list  # item ids as strings, or None
    automata: list


def hashed(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """A place in a table of ``size`` (a power of two) for each block."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (x >> np.uint64(33)) & np.uint64(size - 1)


def joint(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return last.astype(np.int64) << np.int64(32) | before.astype(np.int64)


def build(items: Iterable[tuple[object, list[bytes]]], width: int = WIDTH) -> Tables:
    """Tables for the runs of ``width`` words of (id, words); a shorter item is one run."""
    words: dict[bytes, int] = {}
    names: dict[str | None, int] = {}
    runs: dict[int, list] = {}
    for item, text in items:
        if text:
            own = names.setdefault(None if item is None else str(item), len(names))
            ids = np.array([words.setdefault(w, len(words)) for w in text], np.int32)
            m = min(width, len(ids))
            seen = np.lib.stride_tricks.sliding_window_view(ids, m)[:, ::-1]
            runs.setdefault(m, []).append((seen, np.full(len(seen), own, np.int32)))
    automata = []
    for m, some in sorted(runs.items()):
        every, owner = np.concatenate([r for r, _ in some]), np.concatenate([o for _, o in some])
        patterns, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1))
        b = min(2, m)
        size = max(1 << 10, 1 << int(4 * patterns.size).bit_length())
        shift = np.full(size, m - b + 1, np.int16)
        for far in range(m - b, -1, -1):  # columns run from the last word: a block that ends ``far`` words before the end
            shift[hashed(patterns[:, far], patterns[:, far + b - 1], size)] = far
        automata.append(Automaton(m, b, shift, joint(patterns[:, 0], patterns[:, b - 1]), patterns, first, pairs[:, 1]))
    return Tables(words, list(names), [tuple(a) for a in automata])


def search(words: list[bytes], tables: tuple) -> tuple[list[tuple[int, int]], set]:
    """Spans of words (end exclusive, one for each occurrence) and the items found."""
    known, names, automata = tables
    spans, items, n = [], set(), len(words)
    if not n or not automata:
        return spans, items
    get = known.get
    ids = np.array([get(w, -1) for w in words], np.int32)
    for m, b, shift, suffix, patterns, first, owner in automata:
        if n < m:
            continue
        far = shift[hashed(ids[b - 1 :], ids[: n - b + 1], len(shift))].tolist()  # by the place where a block begins
        at, last = m - b, n - b
        while at <= last:
            jump = far[at]
            if jump:
                at += jump
                continue
            start = at + b - m
            window = ids[start : start + m][::-1]
            key = joint(window[:1], window[b - 1 : b])[0]
            low, high = np.searchsorted(suffix, key, "left"), np.searchsorted(suffix, key, "right")
            for j in range(b, m):  # a bucket is in order: narrow it word by word
                if high - low <= 8:
                    break
                column = patterns[low:high, j]
                low, high = low + np.searchsorted(column, window[j], "left"), low + np.searchsorted(column, window[j], "right")
            for k in range(low, high):
                if (patterns[k] == window).all():
                    spans.append((start, start + m))
                    items.update(names[i] for i in owner[first[k] : first[k + 1]].tolist())
            at += 1
    return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def benchmark_tables(benchmark: DataFrame, item_col: str, text_col: str, width: int, patterns: int) -> Iterator[Tables]:
    """Tables of at most ``patterns`` patterns, one after another; none at least.  A long item goes on in the next table."""
    block, room, sent = [], patterns, 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words, at = alnum_words(r.t), 0
        while at == 0 or at + width <= len(words):  # the runs that begin from ``at`` on
            some = words[at : at + room + width - 1]
            block.append((r.i, some))
            taken = max(1, len(some) - width + 1)
            at, room = at + taken, room - taken
            if room <= 0:
                yield build(block, width)
                block, room, sent = [], patterns, sent + 1
    if block or not sent:
        yield build(block, width)


FOUND = pa.schema(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
FOUND_DDL = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def named(item: str | None) -> tuple:
    return item is not None, item or ""


def scan(tables: tuple, words: list[bytes]) -> dict:
    spans, items = search(words, tables)
    return {"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in merged(spans)], "items": sorted(items, key=named)}


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    patterns: int = PATTERNS,
) -> DataFrame:
    """One row for each document row: id, word count, merged hit spans (in words), item ids."""
    df = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    id_ddl = f"`{id_col}` {df.schema[0].dataType.simpleString()}"
    tables = benchmark_tables(benchmark, item_col, item_text_col, width, patterns)
    now, after = next(tables), next(tables, None)
    if after is None:
        return df.mapInArrow(reader(df, now, [id_col]), f"{id_ddl}, {FOUND_DDL}")
    df = df.select(F.col(id_col), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text")
    key = "h1 bigint, h2 bigint"
    hits = None
    while now is not None:
        some = cut(df.select("h1", "h2", "text").mapInArrow(reader(df, now, ["h1", "h2"], hit_only=True), f"{key}, {FOUND_DDL}"))
        hits = some if hits is None else hits.unionByName(some)
        now, after = after, next(tables, None)

    def added(pdf):
        spans = merged((s["start"], s["end"]) for found in pdf["spans"] for s in found)
        items = sorted({i for found in pdf["items"] for i in found}, key=named)
        out = pdf.iloc[:1].copy()
        out["spans"], out["items"] = [[{"start": s, "end": e} for s, e in spans]], [items]
        return out

    once = hits.dropDuplicates(["h1", "h2", "spans", "items"])  # repeated rows hit alike
    found = once.groupBy("h1", "h2").applyInPandas(added, f"{key}, {FOUND_DDL}").withColumnsRenamed({"n_words": "n", "spans": "s", "items": "i"})
    none = Tables({}, [], [])
    counted = df.mapInArrow(reader(df, none, [id_col, "h1", "h2"]), f"{id_ddl}, {key}, {FOUND_DDL}")
    return counted.join(found, ["h1", "h2"], "left").select(
        F.col(id_col), "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items")
    )


def reader(df: DataFrame, tables: Tables, kept: list[str], *, hit_only: bool = False):
    """For mapInArrow over ``kept`` and the text as last column: the kept columns and what is found."""
    shipped = df.sparkSession.sparkContext.broadcast(tuple(tables))  # at most PATTERNS patterns
    names = [*kept, *FOUND.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shipped.value
        for batch in batches:
            for part in slices(batch):
                rows = [scan(tables, alnum_words(t)) for t in part.column(part.num_columns - 1).to_pylist()]
                found = pa.RecordBatch.from_pylist(rows, FOUND)
                out = pa.RecordBatch.from_arrays(part.columns[:-1] + found.columns, names=names)
                yield out.filter(pa.array([bool(r["spans"]) for r in rows], pa.bool_())) if hit_only else out

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", width: int = WIDTH, patterns: int = PATTERNS) -> DataFrame:
    """The documents without any benchmark passage, with all their columns.

    A benchmark of several tables takes one pass each, with what the others left written between.
    """
    at = docs.columns.index(text_col)
    context = docs.sparkSession.sparkContext

    def step(tables: Tables):
        shipped = context.broadcast(tuple(tables))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shipped.value
            for batch in batches:
                clean = [not search(alnum_words(t.as_py()), tables)[0] for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return keep

    for k, tables in enumerate(benchmark_tables(benchmark, "item_id", "text", width, patterns)):
        docs = (cut(docs) if k else docs).mapInArrow(step(tables), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def digest(items: Iterable[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
s AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT s.doc_id, s.i, s.m, p.item_id FROM s JOIN p USING (m, k)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
