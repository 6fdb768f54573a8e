"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Words belong to groups by their letters (k-means on hashed letter pairs), and within a
group to classes by how frequent they are; what is not among the ``HEAD`` most frequent
words is the group's last class.  The chance of a word is

    P(group | context) * P(class | group, context) * P(word | class)

where the first two are softmaxes over hashed features of the context (the word before,
the two before, and the words two and three places before alone: skips; the class sees the
first two of these together with the group), and the third is the softmax of log(count + 1)
within the class.  Every group's last class holds one more event, for words never seen, so
all chances sum to one.

Training covers every training document.  Words are counted in the tasks and summed by
word.  The documents are dealt to ``ROUNDS`` rounds.  Each round, every task takes stochastic
gradient steps over its documents from the shared weights; the changes are summed block by
block in the cluster, each row's weighted by how often the task met it.

The feature table has a row for every few training tokens, up to ``TABLE`` rows; beyond
half a million tokens contexts share rows.  The weights and the most frequent words are of
bounded size and broadcast.  Counts of all other words stay a table, which grows with the
corpus: a text's rare words are joined to it, summed up for each text.

Defined results: a null or empty text is its end token alone; repeated rows are scored
each on its own; without training documents N = V = 0 and the model is uniform over what
it has; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, space_words, table

HEAD = 100_000
#: Longer words are never in the head, so that its size in bytes is bounded.
HEAD_BYTES = 64
GROUPS, CLASSES = 16, 16
LETTERS = 1024
#: Most rows of the feature table, and training tokens for a row up to that size.
TABLE, TOKENS_A_ROW = 1 << 17, 4
#: Words before that are features, and how many of the features the class sees.
BEFORE, CLASS_FEATURES = 3, 2
ROUNDS = 2
RATE, DAMP = 0.6, 4.0
BATCH = 20_000
BLOCK = 4096
TASKS_A_CORE = 4
#: Changes of a block that one task adds.
MOST_ADDED = 64
CHANGES = "block int, met binary, change binary"
HELD_OUT, FOLDS = 2, 7


def is_training(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents, summed in each task first; the end token is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    seen.update(space_words(text))
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def letter_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter pairs of all words, one after another, and where each word's begin."""
    b = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    pairs = (b[:-1] * 31 + b[1:] * 131) % LETTERS
    keep = np.ones(len(pairs), bool)
    keep[starts[1:] - 1] = False  # from the end of a word to the next one's start
    return pairs[keep], starts - np.arange(len(words))


def letter_vectors(words: list[bytes]) -> np.ndarray:
    """Counts of hashed letter pairs, of length one."""
    pairs, starts = letter_pairs(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(pairs))))
    v = np.bincount(owner * LETTERS + pairs, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype("f4")
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(words: list[bytes], centre: np.ndarray) -> np.ndarray:
    """The group of each word: its length does not change which centre is nearest."""
    if not words:
        return np.zeros(0, np.int64)
    pairs, starts = letter_pairs(words)
    return np.add.reduceat(np.ascontiguousarray(centre.T)[pairs], starts, axis=0).argmax(1)


def centres(words: list[bytes], seed: int = 5, sample: int = 8_000, steps: int = 10) -> np.ndarray:
    """Spherical k-means over the most frequent words."""
    r = np.random.default_rng(seed)
    if not words:
        return r.normal(size=(GROUPS, LETTERS)).astype("f4")
    x = letter_vectors(words[:sample])
    c = x[r.integers(len(x), size=GROUPS)].copy()
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        for g in range(GROUPS):
            if (own == g).any():
                m = x[own == g].sum(0)
                c[g] = m / np.linalg.norm(m)
    return c


class Model(NamedTuple):
    words: list  # of the head, most frequent first; the last is the end token, as None
    counts: np.ndarray
    group: np.ndarray
    cls: np.ndarray  # class within the group; CLASSES - 1 is the group's rest
    log_z: np.ndarray  # GROUPS x CLASSES: log10 of the sum of counts + 1
    centre: np.ndarray
    total: int  # N
    types: int  # V
    weights: np.ndarray  # 2 x rows x GROUPS (as many classes as groups)
    bias: tuple  # GROUPS, and GROUPS x CLASSES


class Reader:
    """Words to head places, groups and context ids."""

    def __init__(self, model: Model):
        self.at = {w: i for i, w in enumerate(model.words) if w is not None}
        self.end = len(model.words) - 1
        self.centre = model.centre

    def ids(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each text the head place of each word, or head size + group; then the end."""
        get = self.at.get
        sizes = np.array([len(d) + 1 for d in docs])
        ends = np.cumsum(sizes)
        out = np.full(int(ends[-1]) if len(docs) else 0, self.end)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        flat = [w for d in docs for w in d]
        out[inner] = [get(w, -1) for w in flat]
        far = np.flatnonzero(out < 0)
        if len(far):
            place = np.flatnonzero(inner)
            back = np.searchsorted(place, far)
            out[far] = self.end + 1 + nearest([flat[k] for k in back.tolist()], self.centre)
        return np.split(out, ends[:-1])


def contexts(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens, and the tokens one, two ... places before; ``size`` stands for none."""
    tokens, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for k in range(1, BEFORE + 1):
        before = np.full(len(tokens), size)
        before[k:] = tokens[:-k]
        before[place < k] = size
        out.append(before)
    return tokens, out


def hashed(before: list[np.ndarray], salt, rows: int) -> list[np.ndarray]:
    """Rows of the features: the word before, the two before, and each of the others alone."""
    a, b, c = np.int64(0x5851F42D4C957F2D), np.int64(0x14057B7EF767814F), np.int64(0x2545F4914F6CDD1D)
    mask, salt = np.int64(rows - 1), np.asarray(salt, np.int64) * c
    with np.errstate(over="ignore"):
        mixed = [before[0] * a + 1, before[0] * a + before[1] * b + 2] + [x * b + 3 + k for k, x in enumerate(before[1:])]
        return [((x ^ salt) * a >> np.int64(40)) & mask for x in mixed]


class Tables:
    """Group and class of each token id, for both softmaxes."""

    def __init__(self, model: Model):
        rest = np.arange(GROUPS)
        self.group = np.concatenate([model.group, rest])
        self.cls = np.concatenate([model.cls, np.full(GROUPS, CLASSES - 1)])
        self.size = len(self.group)


def logits(weights: np.ndarray, bias: tuple, before: list[np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For both softmaxes the scores, a column for each class, and the features' rows."""
    for level in (0, 1):
        rows = hashed(before, 7 if level == 0 else group + 11, weights.shape[1])[: None if level == 0 else CLASS_FEATURES]
        z = weights[level].take(rows[0], 0)  # copies rows faster than an index does
        z += bias[0] if level == 0 else bias[1].take(group, 0)
        for r in rows[1:]:
            z += weights[level].take(r, 0)
        yield z, rows


def largest(z: np.ndarray) -> np.ndarray:
    """The largest of each row's GROUPS values, a column; by halves, as numpy is slow along short rows."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z


def radix_order(rows: np.ndarray) -> np.ndarray:
    """What puts row numbers under 2**24 in order; numpy sorts small integers by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    return order[np.argsort((rows >> 16).astype(np.uint8)[order], kind="stable")]


def learn(weights: np.ndarray, met: np.ndarray, bias: tuple, tables: Tables, tokens: np.ndarray, before: list[np.ndarray]) -> None:
    """One gradient step, in place: each row moves by its mean gradient, damped while it is rare; ``met`` counts the rows."""
    group = tables.group[tokens]
    for level, (z, features) in enumerate(logits(weights, bias, before, group)):
        z -= largest(z)
        d = np.exp(z, out=z)
        d /= d.sum(1, keepdims=True)
        d[np.arange(len(d)), group if level == 0 else tables.cls[tokens]] -= 1
        for rows in features:
            order = radix_order(rows)
            row = rows[order]
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            n = np.diff(np.append(start, len(row)))
            met[level][row[start]] += n
            once = n == 1
            alone, change = row[start[once]], d.take(order[start[once]], 0)
            change *= np.float32(RATE / (1 + DAMP))
            weights[level][alone] = np.subtract(weights[level].take(alone, 0), change, out=change)
            if not once.all():
                many, of = n[~once], order[np.repeat(~once, n)]
                sums = np.add.reduceat(d.take(of, 0), np.cumsum(many) - many, axis=0)
                weights[level][row[start[~once]]] -= (RATE / (many + DAMP)).astype("f4")[:, None] * sums


def added_up(changes: DataFrame, tasks: int) -> DataFrame:
    """One row for each block: its changes' mean; in two steps only where more tasks give changes than one can add."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total = 0.0, 0.0
        for met, change in zip(pdf["met"], pdf["change"]):
            own = np.frombuffer(met, "f4")
            n, total = n + own, total + own[:, None] * np.frombuffer(change, np.float16).reshape(-1, GROUPS).astype("f4")
        mean = (total / np.maximum(n, 1)[:, None]).astype(np.float16)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "met": [n.astype("f4").tobytes()], "change": [mean.tobytes()]})

    if tasks > MOST_ADDED:
        salt = F.pmod(F.spark_partition_id(), F.lit(MOST_ADDED))
        changes = changes.withColumn("salt", salt).groupBy("block", "salt").applyInPandas(added, CHANGES)
    return changes.groupBy("block").applyInPandas(added, CHANGES)


def train_round(docs: DataFrame, model: Broadcast, weights: np.ndarray) -> np.ndarray:
    """Weights after every task's steps over its documents: each row by its mean change, weighted by how often it was met."""
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast(weights)
    tasks = TASKS_A_CORE * context.defaultParallelism
    docs = docs.coalesce(tasks)  # a task's changes are as large as the weights, however few its documents
    cuts = range(0, weights.shape[0] * weights.shape[1], BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = Model(*model.value), shipped.value.copy()
        met = np.zeros(w.shape[:2], np.int64)
        reader, tables = Reader(m), Tables(m)
        held: list[np.ndarray] = []
        size = 0

        def step() -> None:
            nonlocal held, size
            if held:
                tokens, before = contexts(held, tables.size)
                for at in range(0, len(tokens), BATCH):
                    learn(w, met, m.bias, tables, tokens[at : at + BATCH], [x[at : at + BATCH] for x in before])
                held, size = [], 0

        for batch in batches:
            for part in slices(batch):
                some = reader.ids([space_words(text) for text in part.column(0).to_pylist()])
                held += some
                size += sum(map(len, some))
                if size >= BATCH:
                    step()
        step()
        if met.any():
            change, n = (w - shipped.value).reshape(-1, GROUPS).astype(np.float16), met.ravel().astype("f4")
            full = [at for at in cuts if n[at : at + BLOCK].any()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at // BLOCK for at in full], pa.int32()),
                    pa.array([n[at : at + BLOCK].tobytes() for at in full], pa.binary()),
                    pa.array([change[at : at + BLOCK].tobytes() for at in full], pa.binary()),
                ],
                names=["block", "met", "change"],
            )

    out = weights.copy().reshape(-1, GROUPS)
    for r in added_up(docs.mapInArrow(run, CHANGES), tasks).toLocalIterator():  # half as large as the weights
        change = np.frombuffer(r.change, np.float16).reshape(-1, GROUPS)
        out[r.block * BLOCK : r.block * BLOCK + len(change)] += change
    shipped.destroy()
    return out.reshape(weights.shape)


def table_rows(tokens: int) -> int:
    """Rows of the feature table, a power of two."""
    return min(TABLE, max(1 << 12, 1 << (tokens // TOKENS_A_ROW).bit_length()))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the (word, c) table of all training words."""
    spark = docs.sparkSession
    own = docs.filter(is_training(id_col)).select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(rounds)).alias("round"))
    counts = cut(count_words(own.select("text")))
    n_docs = own.count()
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    short = counts.filter(F.length("word") <= HEAD_BYTES)
    least, room = 1 << 62, head  # the smallest count so that no more than ``head`` words have it
    steps = short.groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.min("c").alias("least"), F.count("*").alias("n")).orderBy(F.desc("b"))
    for r in steps.collect():  # four rows for each doubling of a count
        if r.n > room:
            break
        least, room = r.least, room - r.n
    rows = short.filter(F.col("c") >= least).collect()  # at most ``head`` short words
    rows.sort(key=lambda r: (-r.c, bytes(r.word)))
    words = [bytes(r.word) for r in rows]
    centre = centres(words)
    group = nearest(words, centre)
    n = np.array([r.c for r in rows] + [n_docs], np.int64)
    group = np.append(group, 0)
    cls = np.zeros(len(n), np.int64)
    for g in range(GROUPS):
        at = np.flatnonzero(group == g)
        if len(at):
            at = at[np.argsort(-n[at], kind="stable")]
            share = np.cumsum(np.sqrt(n[at] + 1.0))
            cls[at] = np.minimum((share / share[-1] * (CLASSES - 1)).astype(int), CLASSES - 2)
    shipped_centre = spark.sparkContext.broadcast(centre)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                g = nearest(part.column(0).to_pylist(), shipped_centre.value)
                sums = np.bincount(g, part.column(1).to_numpy() + 1.0, GROUPS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(sums)], names=["g", "z"])

    rest = counts.filter((F.length("word") > HEAD_BYTES) | (F.col("c") < least))
    z = np.zeros((GROUPS, CLASSES))
    np.add.at(z, (group, cls), n + 1.0)
    for r in rest.mapInArrow(groups, "g bigint, z double").groupBy("g").agg(F.sum("z").alias("z")).collect():
        z[r.g, CLASSES - 1] += r.z
    z[:, CLASSES - 1] += 1  # a word never seen
    mass = z.sum(1)
    bias = (np.log(mass / mass.sum()).astype("f4"), np.log(np.maximum(z, 1e-9) / mass[:, None]).astype("f4"))
    end_seen = int(n_docs > 0)
    model = Model(words + [None], n, group, cls, np.log10(np.maximum(z, 1e-300)), centre, int(totals["n"]) + n_docs, int(totals["v"]) + end_seen, np.zeros((2, table_rows(int(totals["n"]) + n_docs), GROUPS), "f4"), bias)
    shared = spark.sparkContext.broadcast(tuple(model._replace(weights=None)))
    weights = model.weights
    for k in range(rounds):
        weights = train_round(own.filter(F.col("round") == k).select("text"), shared, weights)
    return model._replace(weights=weights), counts


def class_log10(model: Model, tables: Tables, docs: list[np.ndarray]) -> np.ndarray:
    """log10 P(group) P(class) of every token of the given documents, one after another."""
    tokens, before = contexts(docs, tables.size)
    out = np.zeros(len(tokens))
    for at in range(0, len(tokens), BATCH):
        t = tokens[at : at + BATCH]
        group, rows = tables.group[t], np.arange(len(t))
        for level, (z, _) in enumerate(logits(model.weights, model.bias, [x[at : at + BATCH] for x in before], group)):
            top = largest(z)
            own = z[rows, group if level == 0 else tables.cls[t]] - top[:, 0]
            z -= top
            out[at : at + BATCH] += own - np.log(np.exp(z, out=z).sum(1))
    return out / math.log(10)


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: tokens, known tokens, log10 chance by counts alone and by the model."""
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shipped.value)
        reader, tables = Reader(m), Tables(m)
        lid = np.log10(m.counts + 1.0)
        base_cost = math.log10(m.total + m.types + 1)
        known_end = int(m.counts[-1] > 0)
        for batch in batches:
            for part in slices(batch, 256):
                words = [space_words(text) for text in part.column(1).to_pylist()]
                docs = reader.ids(words)
                rare = [[w[k] for k in np.flatnonzero(ids > reader.end).tolist()] for w, ids in zip(words, docs)]
                p = class_log10(m, tables, docs)
                tokens = np.concatenate(docs)
                head = tokens <= reader.end
                counted = np.where(head, lid[np.minimum(tokens, reader.end)], 0.0)
                within = counted - m.log_z[tables.group[tokens], tables.cls[tokens]]
                starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
                sizes = np.array([len(d) for d in docs])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes),
                        pa.array(np.add.reduceat(head.astype(np.int64), starts) - (1 - known_end)),
                        pa.array(np.add.reduceat(counted, starts) - sizes * base_cost),
                        pa.array(np.add.reduceat(p + within, starts)),
                        pa.array(rare, pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    id_type = df.schema[0].dataType.simpleString()
    ddl = f"doc_id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<binary>"
    rows = cut(df.mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id()))
    more = (
        rows.select("row", F.explode("rare").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.count_if(F.col("c") > 0).alias("known"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"),
        )
    )
    return rows.drop("rare").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *train(docs))
    return scored.select("doc_id", (~is_training("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
