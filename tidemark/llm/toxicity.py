"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

A token that is not plain letters is a lattice: a character may stand for itself, for
the letters it imitates (1 for i or l, $ for s), for nothing (a dot between letters, one
more copy of the letter before), at a price each, and a word may end at a sign or, at a
higher price, between any two characters.  A run of single characters set apart by white
space is one lattice in which words end at any gap, more cheaply at a wider one.  Viterbi
finds the cheapest path under a character language model of the training words, for tokens
of any length.  Letters that are no known word but
hold one that tells for toxicity are cut into words in a second pass.  A logistic model over the restored words gives the score.

Both models are fitted in the cluster on all labelled rows whose crc32(id) mod 5 is not 0.
Words and disguised tokens are counted by document and label, each distinct token is restored
once, features are chosen by the counts of all of them, and the logistic model is fitted by
L-BFGS whose sums run over every row.  Only the size of the model is bounded: its letters'
sequences (``GRAMS``), its dictionary (``WORDS``) and its features (``FEATURES``) are the
heaviest by those counts.  Scoring is row-local over all rows, without a shuffle.

Defined results: a null or empty text scores what the model gives for no words; labels
that are null or belong to no document teach nothing; without any label all scores are
0.0; repeated rows are scored each on its own; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import crc_mod, cut, shared_dir, slices, table

#: Sizes of the model, which is broadcast; counts behind them are of all rows.
WORDS, GRAMS, FEATURES = 200_000, 500_000, 4_000
#: A word is a feature where its share of toxic documents has a chance under e**-EVIDENCE (Chernoff).
EVIDENCE = 14.0
MIN_DOCS = 4
STEMS = (4, 5, 6, 7, 8)
ORDER = 4
HOLD_OUT = 5
#: L2 of the logistic model, most steps of its fit and the relative gain that ends it.
L2, STEPS, GAIN = 3e-6, 50, 1e-4
CACHE, CACHE_CHARS = 600_000, 20_000_000
#: So many labels go to every task, nine bytes each; with more, or where ids are no integers, texts are shuffled to their labels.
LABELS = 8_000_000

#: Characters and the letters they imitate.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
IMITATE, SKIP, SKIP_SIGN, REPEAT, LOSE = 1.2, 0.4, 3.5, 0.7, 6.0
#: What the end of a word costs between two characters, at a sign, at a gap and at a wide gap; and a word across a wide gap.
JOINED, AT_SIGN, AT_GAP, AT_WIDE, ACROSS = 6.0, 1.0, 0.5, 0.0, 4.0
#: What a word costs, when a run of letters is cut into words, besides its letters where training did not have it;
#: and by how much a word that training had is cheaper than -ln of its share.
UNKNOWN, KNOWN = 4.0, 2.0
START = "^^^"

TAIL = re.compile(r"([^\w\s])\1\1+$")
EDGE = ".,;:?\"'()[]{}#%&*|<>/\\-_=~`^…«»“”‘’"
SIGNS = EDGE + "!$+"
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
RUNS = re.compile(r"(.)\1\1+")
REPEATS = re.compile(r"(.)\1+")


def sequences(words: Iterable[tuple[str, int]]) -> dict[str, float]:
    """Runs of ORDER characters of words and how heavy they are, each word log(1 + its count)."""
    out: dict[str, float] = {}
    for word, n in words:
        weight, padded = math.log1p(n), START + word + "$"
        for i in range(ORDER, len(padded) + 1):
            gram = padded[i - ORDER : i]
            out[gram] = out.get(gram, 0.0) + weight
    return out


class Letters:
    """Interpolated character n-grams of distinct words, each weighted by log(1 + its count)."""

    def __init__(self, words: dict[str, int], grams: dict[str, float] | None = None, total: float | None = None):
        """Words with their counts; sequences and total weight, where these come from more words than those."""
        total = sum(math.log1p(n) for n in words.values()) if total is None else total
        self.words = {w: max(0.0, math.log(total / math.log1p(n)) - KNOWN) for w, n in words.items()}
        self.longest = max(map(len, words), default=0)
        self.counts: dict[str, dict[str, float]] = {}
        for gram, weight in (sequences(words.items()) if grams is None else grams).items():
            for k in range(ORDER):
                c = self.counts.setdefault(gram[ORDER - 1 - k : -1], {})
                c[gram[-1]] = c.get(gram[-1], 0.0) + weight
        self.totals = {k: sum(v.values()) for k, v in self.counts.items()}
        self.memo: dict[tuple[str, str], float] = {}

    def cost(self, context: str, c: str) -> float:
        """-ln P(c | context)."""
        found = self.memo.get((context, c))
        if found is None:
            p = 1e-5
            for k in range(ORDER):
                total = self.totals.get(context[ORDER - 1 - k :], 0.0)
                if total:
                    share = total / (total + len(self.counts[context[ORDER - 1 - k :]]))
                    p = (1 - share) * p + share * self.counts[context[ORDER - 1 - k :]].get(c, 0.0) / total
            found = self.memo[context, c] = -math.log(p)
            if len(self.memo) > 500_000:
                self.memo.clear()
        return found

    def decode(self, token: str) -> list[str]:
        return self.cheapest(token)[1]

    def cheapest(self, token: str) -> tuple[float, list[str]]:
        """The cheapest path through the token's lattice: its price and its words."""
        best: dict[str, tuple[float, tuple | None]] = {START: (0.0, None)}  # context: price, path as (rest, character)
        for ch, gap in characters(token):
            if gap is not None:
                end, stay = (JOINED, 0.0) if gap == 0 else (AT_GAP, 0.0) if gap == 1 else (AT_WIDE, ACROSS)
                over = min(((p + self.cost(k, "$") + end, (w, " ")) for k, (p, w) in best.items() if k != START), key=lambda x: x[0], default=None)
                if stay:
                    best = {k: (p + stay * (k != START), w) for k, (p, w) in best.items()}
                if over and (START not in best or over[0] < best[START][0]):
                    best[START] = over
            after: dict[str, tuple[float, tuple | None]] = {}
            imitated = LEET.get(ch, "")
            choices = [(c, IMITATE) for c in imitated]
            letter = ch.isalpha()
            if letter:
                choices.append((ch, 0.0))
            lose = LOSE if ch.isalnum() else SKIP_SIGN if ch in LEET else SKIP
            sign = not ch.isalnum()
            for context, (price, path) in best.items():
                for c, extra in choices:
                    p, k = price + extra + self.cost(context, c), context[1:] + c
                    if k not in after or p < after[k][0]:
                        after[k] = (p, (path, c))
                last = context[-1]
                same = last == ch or last in imitated
                if same or not letter:  # a letter is never lost but as one more copy
                    p = price + (REPEAT if same else lose)
                    if context not in after or p < after[context][0]:
                        after[context] = (p, path)
                if sign and context != START:
                    p = price + self.cost(context, "$") + AT_SIGN
                    if START not in after or p < after[START][0]:
                        after[START] = (p, (path, " "))
            best = after
        price, path = min(((p + (self.cost(k, "$") if k != START else 0.0), w) for k, (p, w) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            path, c = path
            out.append(c)
        return price, "".join(reversed(out)).split()

    def segment(self, word: str) -> list[str]:
        """Letters cut into words by the cheapest path over known words and, letter by letter, unknown ones."""
        ends: list[tuple[float, tuple | None]] = [(0.0, None)]  # at each place where a word may begin: price, (rest, length)
        inside: dict[str, tuple[float, tuple]] = {}  # an unknown word under way: context -> price, where it began
        for i in range(1, len(word) + 1):
            c = word[i - 1]
            after: dict[str, tuple[float, tuple]] = {}
            for context, (p, start) in [*inside.items(), (START, (ends[i - 1][0] + UNKNOWN, (i - 1,)))]:
                k, x = context[1:] + c, p + self.cost(context, c)
                if k not in after or x < after[k][0]:
                    after[k] = (x, start)
            inside = after
            best = min(((p + self.cost(k, "$"), (start[0],)) for k, (p, start) in inside.items()), key=lambda x: x[0])
            for n in range(1, min(i, self.longest) + 1):
                known = self.words.get(word[i - n : i])
                if known is not None and ends[i - n][0] + known <= best[0]:
                    best = (ends[i - n][0] + known, (i - n,))
            ends.append(best)
        out, i = [], len(word)
        while i:
            (start,) = ends[i][1]
            out.append(word[start:i])
            i = start
        return out[::-1]


def characters(token: str) -> Iterator[tuple[str, int | None]]:
    """Each character and the gap before it: none at the start, 0 to its neighbour, 1 or 2 (wide) in a spaced run."""
    gap = None
    for ch in token:
        if ch == " ":
            gap = 1 if not gap else 2
        else:
            yield ch, gap
            gap = 0


def plain(token: str) -> str | None:
    """The word a token plainly is, or None where it has to be decoded."""
    if token.isalpha() and not RUNS.search(token):
        return token
    core = TAIL.sub("", token).strip(EDGE)
    bare = core.rstrip(SIGNS)
    if bare.isalpha() and not RUNS.search(bare):
        return bare
    core = RUNS.sub(r"\1\1", core)
    if not core or core.isdigit() or not any(c.isalpha() or c in "@$!" for c in core):
        return core
    return None


def restore(token: str, letters: Letters) -> list[str]:
    """The words a token stands for."""
    if " " in token:
        return letters.decode(token)
    word = plain(token)
    return letters.decode(RUNS.sub(r"\1\1", TAIL.sub("", token).strip(EDGE))) if word is None else [word]


def spaced(run: str) -> str:
    """A run of single characters with one space for its smallest gap and two for wider ones."""
    parts = re.split(r"(\s+)", run)
    least = min(map(len, parts[1::2]))
    return "".join(x if k % 2 == 0 else " " if len(x) == least else "  " for k, x in enumerate(parts))


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens in lower case, and the runs of characters set apart (which hold spaces)."""
    text = (text or "").lower()
    out = set(text.split())
    for m in SPACED.finditer(text):
        if any(c.isalpha() for c in m[0]):
            out.add(spaced(m[0]))
    return out


def evidence(k: int, n: int, rate: float) -> float:
    """n times the divergence of the share k / n from the rate."""
    out = 0.0
    for count, p in ((k, rate), (n - k, 1 - rate)):
        if count:
            out += count * math.log(count / n / p)
    return out


def features_of(word: str) -> Iterator[str]:
    """A restored word and its beginnings, so that inflected and compound forms count too."""
    yield word
    for k in STEMS:
        if len(word) > k:
            yield word[:k] + "*"


def squeezed(word: str) -> str:
    return REPEATS.sub(r"\1", word)


class Counts:
    """How many documents, and toxic ones, hold a word, a beginning of words (with a star) or, after a space, a token that has to be restored."""

    def __init__(self) -> None:
        self.rows = self.toxic = self.chars = 0
        self.key: dict[str, str] = {}
        self.seen: Counter = Counter()
        self.bad: Counter = Counter()

    def add(self, text: str | None, y: int) -> None:
        tokens = tokens_of(text)
        for t in tokens:
            if t in self.key:
                continue
            w = None if " " in t else plain(t)
            self.key[t] = w if w and w.isalpha() else " " + t
            self.chars += len(t)
        keys = set(map(self.key.__getitem__, tokens))
        keys.update([w[:k] + "*" for w in keys if w[0] != " " for k in STEMS if len(w) > k])  # once a document, like words
        self.seen.update(keys)
        if y:
            self.bad.update(keys)
        self.rows += 1
        self.toxic += y


def features_by(words: Iterable[tuple[str, int, int]], letters: Letters) -> dict[str, list[int]]:
    """For every feature of counted words and tokens, how often documents and toxic ones hold one of these."""
    out: dict[str, list[int]] = {}
    for key, n, bad in words:
        for f in {f for word in restore(key[1:], letters) for f in features_of(word)} if key[0] == " " else [key]:
            both = out.setdefault(f, [0, 0])
            both[0] += n
            both[1] += bad
    return out


def unfitted(words: dict[str, int], grams: dict[str, float], total: float, chosen: list[tuple[str, bool]], bias: float) -> dict:
    """A model with its features, each with whether it tells for toxicity, before they have weights."""
    return {"words": words, "grams": grams, "total": total, "weights": dict.fromkeys((f for f, _ in chosen), 0.0), "telling": [f for f, more in chosen if more], "bias": bias}


NOTHING: dict = {"words": {}, "grams": {}, "total": 0.0, "weights": {}, "telling": [], "bias": None}


def rate_of(toxic: int, rows: int) -> float:
    return (toxic + 0.5) / (rows + 1)


def slopes(x: np.ndarray, sizes: np.ndarray, col: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and its gradient, summed over n rows of each set of features, these one after another; the bias is the last weight."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    z = np.bincount(row, x[col], len(sizes)) + x[-1]
    d = n * (0.5 + 0.5 * np.tanh(z / 2) - y)
    g = np.bincount(col, d[row], len(x)).astype("f8")
    g[-1] = d.sum()
    return float((n * (np.logaddexp(0, z) - y * z)).sum()), g


def minimise(sums: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rows: int) -> np.ndarray:
    """L-BFGS on the mean loss with L2 on all but the bias."""

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = sums(x)
        w = np.append(x[:-1], 0.0)
        return loss / rows + L2 / 2 * float(w @ w), g / rows + L2 * w

    loss, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        way, kept = -g, []
        for s, y in reversed(past):
            kept.append(float(s @ way) / float(s @ y))
            way = way - kept[-1] * y
        if past:
            s, y = past[-1]
            way = way * (float(s @ y) / float(y @ y))
        elif g.any():
            way = way / np.linalg.norm(g)
        for (s, y), a in zip(past, reversed(kept)):
            way = way + (a - float(y @ way) / float(s @ y)) * s
        step, down = 1.0, float(g @ way)
        while True:
            new_loss, new_g = f(x + step * way)
            if new_loss <= loss + 1e-4 * step * down or step < 1e-6:
                break
            step /= 4
        if new_loss >= loss:
            return x
        s, y = step * way, new_g - g
        if float(s @ y) > 1e-12 * float(y @ y):
            past = [*past[-9:], (s, y)]
        done = loss - new_loss <= GAIN * loss
        x, loss, g = x + s, new_loss, new_g
        if done:
            break
    return x


def with_weights(model: dict, sums: Callable[[np.ndarray], tuple[float, np.ndarray]], rows: int) -> dict:
    x = minimise(sums, np.append(np.zeros(len(model["weights"])), model["bias"]), rows)
    return model | {"weights": dict(zip(model["weights"], x[:-1].tolist())), "bias": float(x[-1])}


def fit(rows: Iterable[tuple[str | None, int]]) -> dict:
    """Character model and word weights from (text, label) pairs, in one process."""
    rows = list(rows)
    if not rows:
        return NOTHING
    counts = Counts()
    for text, y in rows:
        counts.add(text, y)
    words = {w: n for w, n in counts.seen.items() if w[0] != " " and w[-1] != "*"}
    grams, total = sequences(words.items()), sum(math.log1p(n) for n in words.values())
    rate = rate_of(counts.toxic, counts.rows)
    found = features_by(((w, n, counts.bad[w]) for w, n in counts.seen.items()), Letters(words, grams, total))
    lift = {f: evidence(k, n, rate) for f, (n, k) in found.items() if n >= MIN_DOCS}
    chosen = sorted((f for f, x in lift.items() if x >= EVIDENCE), key=lambda f: (-lift[f], f))[:FEATURES]
    model = unfitted(words, grams, total, [(f, found[f][1] > rate * found[f][0]) for f in chosen], math.log(rate / (1 - rate)))
    scorer = Scorer(model)
    sets = Counter((scorer.ids(text), y) for text, y in rows)
    sizes, col = np.array([len(i) for i, _ in sets]), np.array([i for own, _ in sets for i in own], np.int64)
    y, n = np.array([y for _, y in sets], "f8"), np.array(list(sets.values()), "f8")
    return with_weights(model, lambda x: slopes(x, sizes, col, y, n), len(rows))


class Scorer:
    def __init__(self, model: dict):
        self.letters = Letters(model["words"], model["grams"], model["total"])
        self.names = list(model["weights"])
        self.at = {w: i for i, w in enumerate(self.names)}
        self.weights = list(model["weights"].values())
        self.bias = model["bias"]
        self.squeezed = {squeezed(w): i for w, i in reversed(self.at.items()) if not w.endswith("*")}
        self.starts = {w.rstrip("*")[: STEMS[0]] for w in self.at}
        self.inner: dict[str, list[str]] = {}
        for w in model["telling"]:
            if len(w) >= STEMS[0] and not w.endswith("*"):
                self.inner.setdefault(w[: STEMS[0]], []).append(w)
        self.seen: set[str] = set()
        self.seen_chars = 0
        self.useful: dict[str, tuple[int, ...]] = {}

    def holds(self, word: str) -> bool:
        """Whether a telling word stands inside."""
        n = STEMS[0]
        for i in range(len(word) - n + 1):
            some = self.inner.get(word[i : i + n])
            if some and any(word.startswith(w, i) for w in some):
                return True
        return False

    def features(self, token: str) -> tuple[int, ...]:
        words, known = restore(token, self.letters), self.letters.words
        if not self.at:
            return ()
        for word in [w for w in words if w not in known and w.isalpha() and self.holds(w)]:
            words = words + self.letters.segment(word)
        out: set[int] = set()
        for word in words:
            found = [self.at[f] for f in features_of(word) if f in self.at] if word[: STEMS[0]] in self.starts else []
            if not found and word not in known:
                one = squeezed(word)
                if one in self.squeezed:
                    found = [self.squeezed[one]]
            out.update(found)
        return tuple(sorted(out)) if out else ()

    def ids(self, text: str | None) -> tuple[int, ...]:
        """The features of a text, as places in the list of weights."""
        tokens = tokens_of(text)
        for t in tokens - self.seen:
            found = self.features(t)
            if found:
                self.useful[t] = found
        self.seen_chars += sum(map(len, tokens - self.seen))
        self.seen |= tokens
        own = tuple(sorted({i for t in self.useful.keys() & tokens for i in self.useful[t]}))
        if len(self.seen) > CACHE or self.seen_chars > CACHE_CHARS:
            self.seen, self.useful, self.seen_chars = set(), {}, 0
        return own

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        z = self.bias + sum(self.weights[i] for i in self.ids(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class Marks:
    """Labels in order of their ids, repeated ones too."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.toxic = ids[order], toxic[order].astype(np.int8)

    def at(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the labels of each id begin and how many there are."""
        own = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        first = np.searchsorted(self.ids, own)
        return first, np.where(pc.is_valid(ids).to_numpy(zero_copy_only=False), np.searchsorted(self.ids, own, "right") - first, 0)


def marks_of(own: DataFrame) -> Marks | None:
    """The labels (doc_id, toxic), unless they are too many or their ids no integers."""
    if not isinstance(own.schema["doc_id"].dataType, IntegralType) or own.count() > LABELS:
        return None
    found = own.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("tinyint")).toArrow().combine_chunks()
    return Marks(*(np.asarray(c) for c in found.columns))


def partly_counted(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(key, n, bad) of parts of the documents, once for each label (doc_id, toxic) of a document, for ``counted`` to add up."""
    integers = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    marks = marks_of(own) if integers else None
    if marks is None:
        rows, shipped = docs.select("doc_id", "text").join(own, "doc_id").select("text", "toxic"), None
    else:  # texts stay where they are read
        rows = docs.filter(~is_held(F.col("doc_id"))).select(F.col("doc_id").cast("bigint"), "text")
        shipped = docs.sparkSession.sparkContext.broadcast(marks)

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int]]:
        if shipped is None:
            for part in slices(batch):
                yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            return
        first, n = shipped.value.at(batch.column(0))
        some = pa.RecordBatch.from_arrays([batch.column(1), pa.array(first), pa.array(n)], names=["text", "first", "n"]).filter(pa.array(n > 0))
        for part in slices(some):
            for text, at, k in zip(*(c.to_pylist() for c in part.columns)):
                for y in shipped.value.toxic[at : at + k].tolist():
                    yield text, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def out() -> pa.RecordBatch:
            keys = list(counts.seen)
            n, bad = [counts.seen[k] for k in keys], [counts.bad[k] for k in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array([*keys, None], pa.string()), pa.array([*n, counts.rows], pa.int64()), pa.array([*bad, counts.toxic], pa.int64())], names=["key", "n", "bad"]
            )

        for batch in batches:
            for text, y in pairs(batch):
                counts.add(text, y)
                if len(counts.key) > CACHE or counts.chars > CACHE_CHARS:
                    yield out()
                    counts = Counts()
        if counts.rows:
            yield out()

    return rows.mapInArrow(run, "key string, n bigint, bad bigint")


def counted(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(key, n, bad): the labelled documents that hold a word or token, and the toxic ones; all of them under a null key."""
    sums = partly_counted(docs, own).groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    folder = shared_dir(docs.sparkSession)
    sums.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def summed(pairs: DataFrame, names: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], kind: str) -> DataFrame:
    """What tasks give as tables of one key to numbers, summed by the key."""

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in run(batches):
            columns = list(zip(*found.values())) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())] + [pa.array(c) for c in columns], names=["f", *names])

    df = pairs.mapInArrow(arrow, "f string, " + ", ".join(f"{x} {kind}" for x in names))
    return df.groupBy("f").agg(*[F.sum(x).alias(x) for x in names])


def chosen_from(docs: DataFrame, own: DataFrame) -> tuple[dict, int]:
    """The model of documents and their labels (doc_id, toxic) but for its weights, and the number of pairs of these."""
    spark = docs.sparkSession
    counts = counted(docs, own)
    whole = counts.filter("key IS NULL").first()
    if whole is None:
        return NOTHING, 0
    rate = rate_of(whole["bad"], whole["n"])
    held = counts.filter("key IS NOT NULL")
    words = held.filter("NOT startswith(key, ' ') AND NOT endswith(key, '*')").select("key", "n")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = sequences(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield {k: (x,) for k, x in found.items()}

    grams = {r.f: r.x for r in summed(words, ["x"], runs, "double").orderBy(F.desc("x"), "f").limit(GRAMS).collect()}
    total = words.agg(F.coalesce(F.sum(F.log1p("n")), F.lit(0.0))).first()[0]
    known = {r.key: r.n for r in words.orderBy(F.desc("n"), "key").limit(WORDS).toLocalIterator()}
    shipped = spark.sparkContext.broadcast(unfitted(known, grams, total, [], 0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        letters = Scorer(shipped.value).letters
        for batch in batches:
            yield features_by(zip(*(c.to_pylist() for c in batch.columns)), letters)

    n, k = F.col("n"), F.col("bad")
    part = lambda c, p: F.when(c > 0, c * F.log(c / n / p)).otherwise(0.0)
    found = summed(held.select("key", "n", "bad"), ["n", "bad"], features, "bigint").filter(n >= MIN_DOCS)
    lift = found.withColumn("lift", part(k, rate) + part(n - k, 1 - rate)).filter(F.col("lift") >= EVIDENCE)
    chosen = [(r.f, r.bad > rate * r.n) for r in lift.orderBy(F.desc("lift"), "f").limit(FEATURES).collect()]
    shipped.destroy()
    return unfitted(known, grams, total, chosen, math.log(rate / (1 - rate))), whole["n"]


def feature_sets(docs: DataFrame, model: dict) -> DataFrame:
    """(id, ids) for each document row: the features its text has."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select("doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            for part in slices(batch):
                ids = [scorer.ids(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.mapInArrow(scan, f"doc_id {df.schema[0].dataType.simpleString()}, ids array<int>")


def weighed(sets: DataFrame, own: DataFrame, model: dict, rows: int) -> dict:
    """The model with weights fitted on the labelled of the given feature sets; every step sums over all of them."""
    equal = cut(sets.join(own, "doc_id").groupBy("ids", "toxic").agg(F.count("*").cast("double").alias("n")))

    def sums(x: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, g = 0.0, np.zeros(len(x))
            for batch in batches:
                ids = batch.column(0)
                some = slopes(x, pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy())
                loss, g = loss + some[0], g + some[1]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g.tobytes()], pa.binary())], names=["loss", "g"])

        loss, g = 0.0, np.zeros(len(x))
        for r in equal.mapInArrow(run, "loss double, g binary").collect():  # one row for each task
            loss, g = loss + r.loss, g + np.frombuffer(r.g)
        return loss, g

    return with_weights(model, sums, rows)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may teach."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held(F.col("doc_id")))
    return own.select("doc_id", (F.col("toxic").cast("int") != 0).cast("int").alias("toxic"))


def is_held(id_col: F.Column) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % HOLD_OUT == 0


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model fitted on all labelled documents that are not held out."""
    own = labelled(labels)
    model, rows = chosen_from(docs, own)
    if not rows:
        return model
    return weighed(feature_sets(docs.filter(~is_held(F.col("doc_id"))), model), own, model, rows)


def score_toxicity(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: id and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            for part in slices(batch):
                scores = [scorer.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return df.mapInArrow(scan, f"`{id_col}` {df.schema[0].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score under the threshold, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def scored_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) as of score_toxicity with train, but every text is searched for features once for both."""
    own = labelled(labels)
    model, rows = chosen_from(docs, own)
    if not rows:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sets = cut(feature_sets(docs, model))
    model = weighed(sets, own, model, rows)
    weights, bias = np.array(list(model["weights"].values())), model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy())
            z = np.bincount(row, weights[ids.flatten().to_numpy()], batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(0.5 + 0.5 * np.tanh(z / 2))], names=["doc_id", "score"])

    return sets.mapInArrow(run, f"doc_id {sets.schema[0].dataType.simpleString()}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(is_held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def is_held_out(doc_id: object) -> bool:
    return crc_mod(doc_id, HOLD_OUT) == 0
