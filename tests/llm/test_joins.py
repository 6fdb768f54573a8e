"""Operators that join documents with one another or with corpus counts: against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, jaccard, licenses, lm, media, pii
from tidemark.llm.common import alnum_words, space_words

from .fixtures import ODD, documents, empty, prose

# components


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 499: 499, 500: 499}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_few_edges_take_few_tasks_and_equal_those_of_many(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(-900, 900), r.randrange(-900, 900)) for _ in range(700)] + [(k, k + 1) for k in range(2000, 2300)], "u bigint, v bigint")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        few = {(x.node, x.component) for x in components.connected_components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 10
    monkeypatch.setattr(components, "FEW", 0)
    assert {(x.node, x.component) for x in components.connected_components(edges).collect()} == few


# Jaccard join


def shingles(text):
    w = space_words(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_classes(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {k: (len(sets[k]), label[k]) for k in range(len(texts))}


def edited(text, seed, n):
    r = random.Random(seed)
    words = text.split()
    for _ in range(n):
        k = r.randrange(len(words))
        how = r.randrange(3)
        words[k : k + 1] = [["zz%d" % seed], [], [words[k], "yy"]][how]
    return " ".join(words)


def corpus():
    texts = list(ODD)
    for base in range(6):
        text = prose(base, 40 + 60 * base, 5000)
        texts += [text] * (base % 3) + [edited(text, 10 * base + k, 1 + k % 4) for k in range(14)]
    passage = prose(77, 60, 5000)
    texts += [passage + " " + prose(900 + k, 20, 5000) for k in range(15)]
    texts += ["a b", "a b", "A  B", "b a", "one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven"]
    return texts


@pytest.mark.parametrize("cell", [3000, 4])
def test_jaccard_classes_equal_brute_force(spark, monkeypatch, cell):
    """With tiny cells, regions are cut by pivots and joined as blocks."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_jaccard_signatures_never_miss_a_link():
    r = np.random.default_rng(0)
    for n in [10, 11, 12, 15, 19, 20, 21, 37, 38, 60, 111, 150, 400, 1500]:
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            out = int(r.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate([a[out:], r.integers(0, 2**63, int(r.integers(0, n // 9 + 1))).astype(np.uint64)]))
            i = jaccard.intersection(a, b)
            if 100 * i >= 90 * (len(a) + len(b) - i) and len(a) + len(b) != 2 * i:
                assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size


def test_jaccard_of_nothing_and_keep_one(spark):
    assert jaccard.classes(empty(spark)).count() == 0
    docs = documents(spark, ["x y z " + prose(1, 50)] * 3 + [prose(2, 50), None, ""])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]


@pytest.mark.parametrize("cell", [3000, 4])
def test_jaccard_of_repeated_rows_and_clashing_ids(spark, monkeypatch, cell):
    """Rows are judged by their texts, whatever ids they share; one row of each class is kept."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    a, b, c = prose(1, 60, 5000), prose(2, 60, 5000), prose(3, 60, 5000)
    keep = lambda rows: sorted((r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert keep([(1, a)] * 3) == [(1, a)]
    assert keep([(1, a), (5, a), (5, b)]) == [(1, a), (5, b)]
    rows = [(5, b), (5, a), (1, b), (1, c), (1, c), (2, a + " x"), (2, ""), (2, "")]
    assert keep(rows) == sorted([(1, b), (1, c), (2, a + " x"), (2, ""), (2, "")])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([(5, 58, 1), (5, 58, 2), (1, 58, 1), (1, 58, 1), (1, 58, 1), (2, 59, 2), (2, 0, 2), (2, 0, 2)])
    named = spark.createDataFrame([("b", a), ("a", a), (None, a)], "name string, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.classes(named, id_col="name").collect()} == {("a", "a"), ("b", "a"), (None, None)}


def test_jaccard_region_of_copies_of_one_page(spark, monkeypatch):
    """A region far over the size of a cell: most sets link with a pivot, and the rest is joined."""
    monkeypatch.setattr(jaccard, "CELL", 30)
    text = prose(4, 150, 5000)
    texts = [edited(text, k, 1 + k % 9) for k in range(160)] + [prose(5, 150, 5000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_jaccard_of_long_texts(spark):
    """Two copies of a text of 600,000 words that differ in one word, cut by pivots as their cell is too large."""
    words = [f"w{k}" for k in range(600_000)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words[: 500_000]), "a b c d"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(documents(spark, texts)).collect()}
    assert got == {0: (599_998, 0), 1: (599_998, 0), 2: (499_998, 2), 3: (2, 3)}


def brute_copies(texts):
    """Classes at J >= 0.8 on runs of five words."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(space_words, texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {k: (len(sets[k]), label[k]) for k in range(len(texts))}


@pytest.mark.parametrize("cell", [3000, 4])
def test_copies_stage_equals_brute_force(spark, monkeypatch, cell):
    """Five words and 0.8 in the pipeline's stage, with short, long and edited texts and a line many have."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "CELL", cell)
    texts = corpus()
    for base, n in enumerate([6, 9, 14, 25, 50, 100, 100, 400]):
        text = prose(300 + base, n, 5000)
        texts += [text] + [edited(text, 1000 + 20 * base + k, 1 + (k * n) // 120) for k in range(8)]
    words = prose(88, 50, 5000).split()
    texts += [" ".join(words), " ".join(words[:25] + ["other"] + words[26:])]  # 41 of 51, but 45 of 51 on three words
    words = prose(89, 100, 5000).split()
    texts += [" ".join(words), " ".join(words[:30] + ["other"] + words[31:60] + ["another"] + words[61:])]  # 86 of 106
    line = prose(90, 12, 5000)
    texts += [prose(600 + k, 60, 5000) + " " + line for k in range(40)]
    docs, expected = documents(spark, texts), brute_copies(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, width=5, num=4, den=5).collect()}
    assert got == expected
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    assert kept == {k for k, (_, c) in expected.items() if c == k}
    assert not kept & {len(texts) - 41, len(texts) - 43}


def test_jaccard_buckets_share_what_a_link_needs():
    r = np.random.default_rng(1)
    for n in [5, 8, 9, 10, 13, 17, 24, 45, 90, 200, 700, 2000]:
        for _ in range(40):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[int(r.integers(0, n // 5 + 1)) :], r.integers(0, 2**63, int(r.integers(0, n // 4 + 1))).astype(np.uint64)]))
            i = jaccard.intersection(a, b)
            if 5 * i >= 4 * (len(a) + len(b) - i) and len(a) + len(b) != 2 * i:
                shared = lambda x, y: len(np.intersect1d(x, y))
                assert any(shared(g, o) >= max(need, other) for g, need in jaccard.bucketed(a, 4, 5) for o, other in jaccard.bucketed(b, 4, 5))


def test_jaccard_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "q r s t")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.classes(docs).collect()} == {(None, None), (1, 1), (2, 2)}


# licenses


def brute_license(text):
    words = [w.decode() for w in alnum_words(text)]
    places, base = [], set()
    for label, p in licenses.PHRASES.items():
        at = [i for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p]
        places += at
        base |= {label} if at else set()
    labels, share = set(base), 0.0
    for c in (4, 8, 16, 32):
        for at in range(0, len(words), c):
            own, hits = set(words[at : at + 2 * c]), []
            for label, some in licenses.TEMPLATES.items():
                for t in some:
                    tokens = set(licenses.template_tokens(t))
                    if licenses.span(t) == c and len(own & tokens) >= licenses.needed(len(tokens), licenses.THRESHOLD):
                        hits.append((own & tokens, label, len(own & tokens) / len(tokens)))
            for shared, label, s in hits:
                if not any(shared < other or shared == other and s < more for other, _, more in hits):
                    labels.add(label)
                    share = max(share, s)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else share


def test_licenses_equal_brute_force(spark):
    every = [t for some in licenses.TEMPLATES.values() for t in some]
    texts = ODD + every + [prose(70 + k, k % 9) + " " + re.sub(" ", lambda _: "\n" if k % 2 else " ", t) + " " + prose(90 + k, 30) for k, t in enumerate(every)] + [
        prose(1, 20) + "\nLicensed under CC BY-NC 4.0.\n" + prose(2, 20),
        "All rights reserved. all RIGHTS reserved\nthe general public license",
        "This work is licensed under the GNU General Public License, version 3.",
        "license gnu public", "Permission is hereby granted, free of charge, to any one obtaining a copy of this software", "All rights\nreserved",
        "rights " + prose(3, 1000) + " all " + prose(4, 1000) + " reserved",
        every[1] + " and " + every[2] + " and licensed under the Apache License, Version 2.0, released under the MIT License",
    ]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(documents(spark, texts + texts)).collect()}
    assert len(got) == 2 * len(texts)
    for k, t in enumerate(texts + texts):
        assert got[k] == brute_license(t), t
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_licenses_of_every_declaration(spark):
    """Each sentence gives its own label, wrapped lines or not, and so do two in one line and rows without an id."""
    rows = [(label, t) for label, some in licenses.TEMPLATES.items() for t in some]
    texts = [prose(k, 13 + k) + " " + t.replace(" ", "\n# ") + ". " + prose(k + 50, 20) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(None, "Licensed under the Apache License, Version 2.0. " + rows[-10][1] + ". Released under the MIT License.")], "doc_id string, text string")
    got = [r.labels.split(",") for r in licenses.scan_licenses(docs.coalesce(1)).collect()]
    assert len(got) == len(docs.collect())
    for label in licenses.TEMPLATES:
        assert any(label in g for g in got), label
    assert any({"apache-2.0", "mit"} <= set(g) for g in got)
    both = [g for g in got if "cc-by-4.0" in g and "cc-by-nc-4.0" in g]
    assert not both, both


# personal data


def test_pii_surrogates_keep_format_distinctness_and_coreference(spark):
    texts = [
        "mail jo.98@mail5.example.com or JO.98@Mail5.example.com, call +1 (389) 555-5010 or (389) 555-5010",
        "card 4111 1111 1111 1111, 4929348385146306; ip 43.21.141.16 and 10.0.0.1; ssn 123-45-6789",
        "IBAN GB82WEST12345698765432; GB82 WEST 1234 5698 7654 32; Mrs. Maria Müller met John Smith and Dr Smith; Анна Иванова",
        "no entities: 12 345 a@b 1.2.3 999.1.1.1", None, "", "x" * 200_000 + " jo.98@mail5.example.com",
    ]
    docs = documents(spark, texts)
    out = pii.replace(docs)
    assert out.columns == docs.columns
    new = [r.text for r in out.orderBy("doc_id").collect()]
    assert new[3:6] == [texts[3], None, ""]
    for a, b in zip(texts[:3], new[:3]):
        assert re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", a)).split()[0] == re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", b)).split()[0]
    one, two = re.findall(r"\S+@[\w.]+\w", new[0])
    assert one.lower() == two.lower() == new[6].split()[-1] and one != "jo.98@mail5.example.com" and one.endswith(".example.com")
    phones = re.findall(r"\(\d{3}\) 555-\d{4}|\(\d{3}\) \d{3}-\d{4}", new[0])
    assert len(phones) == 2 and phones[0] == phones[1] != "(389) 555-5010" and "+1 (" in new[0]
    digits = re.sub(r"\D", "", re.search(r"card ([\d ]+),", new[1])[1])
    total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits)))
    assert digits[0] == "4" and total % 10 == 0
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", new[1])
    assert ips[1].startswith("10.") and not ips[0].startswith("43.21.") and all(int(x) < 256 for i in ips for x in i.split("."))
    iban = new[2].split()[1].rstrip(";")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    spaced = new[2].split("; ")[1]
    assert spaced.replace(" ", "") == iban and [len(x) for x in spaced.split(" ")] == [4, 4, 4, 4, 4, 2]
    names = re.search(r"Mrs\. (\w+) (\w+) met (\w+) (\w+) and Dr (\w+); (\w+) (\w+)", new[2])
    assert names[1] in pii.GIVEN["latin_f"] and names[3] in pii.GIVEN["latin_m"] and names[6] in pii.GIVEN["cyrillic_f"]
    assert names[4] == names[5] != "Smith"


def test_pii_is_one_to_one(spark):
    rows = [f"(389) 555-{k:04d}" for k in range(0, 10000, 7)] + [f"10.1.{k // 250}.{k % 250}" for k in range(900)] + [f"{4000000000000000 + 37 * k}" for k in range(900)] + [f"u{k}@mail.example.com" for k in range(900)]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    assert pii.collisions(df, pii.KEY).filter("n > 1").count() == 0
    new = df.select(pii.replaced(pii.KEY, F.col("text")).alias("t"))
    assert new.distinct().count() == len(rows)
    other = df.select(pii.replaced("another key", F.col("text")).alias("t"))
    assert new.intersect(other).count() < 20
    assert pii.replace(empty(spark)).count() == 0


# language model


def test_lm_base_equals_brute_force_and_model_adds_up(spark):
    texts = ODD + [prose(k, 30, 60) for k in range(80)]
    docs = documents(spark, texts)
    model, counts = lm.train(docs, head=20)
    got = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    c, n, trained = Counter(), 0, 0
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            w = space_words(t)
            c.update(w)
            n, trained = n + len(w) + 1, trained + 1
    v = len(c) + 1
    for k, t in enumerate(texts):
        w = space_words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((trained + 1) / (n + v + 1))
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    # all words after one context, and one word never seen in each group, have the chances of one event in all
    reader, tables = lm.Reader(model), lm.Tables(model)
    total = 0.0
    before = reader.ids([[b"w1"]])[0][0]
    for w in [*c, None]:
        ids = np.array([before, reader.end if w is None else reader.ids([[w]])[0][0]])
        p = lm.class_log10(model, tables, [ids])[1]
        count = trained if w is None else c[w]
        total += 10 ** (p + math.log10(count + 1) - model.log_z[tables.group[ids[1]], tables.cls[ids[1]]])
    for g in range(lm.GROUPS):
        ids = np.array([before, reader.end + 1 + g])
        total += 10 ** (lm.class_log10(model, tables, [ids])[1] - model.log_z[g, lm.CLASSES - 1])
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lm_learns_from_context(spark):
    r = random.Random(3)
    texts = [" ".join(x for _ in range(40) for x in r.choice([("aa", "bb"), ("cc", "dd"), ("ee", "ff")])) for _ in range(150)]
    model, counts = lm.train(documents(spark, texts))
    held = [x for x in lm.score(documents(spark, texts), model, counts).collect() if zlib.crc32(str(x.doc_id).encode()) % 7 == 2]
    assert sum(x.score for x in held) > 0.9 * sum(x.base_score for x in held)


def test_lm_beats_an_interpolated_bigram_on_held_out_documents(spark):
    """Over held-out documents without a copy in training: better than counts, and than word pairs with the best of five weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, counts = lm.train(docs)
    scored = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    one, two, before, held = Counter(), Counter(), Counter(), {}
    for r in docs.collect():
        words = space_words(r.text) + [None]
        if zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            held[r.doc_id] = words
        else:
            one.update(words)
            two.update(zip([None, *words], words))
            before.update([None, *words[:-1]])
    total, v = sum(one.values()), len(one)
    new = [k for k, w in held.items() if sum(p in two for p in zip(w, w[1:])) <= 0.5 * len(w)]
    n = sum(scored[k].n_tokens for k in new)

    def pairs(prior):
        out = 0.0
        for words in map(held.get, new):
            for x, y in zip([None, *words], words):
                share = before[x] / (before[x] + prior)
                out += math.log10(share * two[x, y] / max(1, before[x]) + (1 - share) * (one[y] + 1) / (total + v + 1))
        return out / n

    found, base = sum(scored[k].score for k in new) / n, sum(scored[k].base_score for k in new) / n
    best = max(pairs(prior) for prior in (10, 30, 100, 300, 1000))
    print(f"{len(new)} of {len(held)}: base {base:.4f}, pairs {best:.4f}, model {found:.4f}")
    assert found > best and found > base + 0.05


def test_lm_rows_are_copied_and_not_indexed():
    r = np.random.default_rng(4)
    weights, bias = r.normal(size=(2, lm.TABLE, lm.GROUPS)).astype("f4"), (r.normal(size=16).astype("f4"), r.normal(size=(16, 16)).astype("f4"))
    before, group = [r.integers(1000, size=lm.BATCH) for _ in range(lm.BEFORE)], r.integers(16, size=lm.BATCH)

    class Rows(np.ndarray):
        def __getitem__(self, at):
            assert not isinstance(at, np.ndarray)  # twice the time of take
            return super().__getitem__(at)

    for level, (z, rows) in enumerate(lm.logits(weights.view(Rows), bias, before, group)):
        plain = weights[level][rows[0]] + (bias[0] if level == 0 else bias[1][group])
        for x in rows[1:]:
            plain += weights[level][x]
        assert (z == plain).all() and (lm.largest(z) == plain.max(1, keepdims=True)).all()


def test_lm_of_nothing(spark):
    model, counts = lm.train(empty(spark))
    assert lm.score(empty(spark), model, counts).count() == 0
    assert model.total == 0 and all(r.score < 0 for r in lm.score(documents(spark, ["a b", None]), model, counts).collect())


def test_lm_changes_of_few_tasks_are_shuffled_once(spark):
    r = np.random.default_rng(3)
    rows = [(k % 2, r.integers(1, 5, 4).astype("f4").tobytes(), r.normal(size=(4, lm.GROUPS)).astype(np.float16).tobytes()) for k in range(6)]
    changes = spark.createDataFrame(rows, lm.CHANGES)
    once, twice = lm.added_up(changes, lm.MOST_ADDED), lm.added_up(changes, lm.MOST_ADDED + 1)
    shuffles = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for d in (once, twice)]
    assert shuffles == [1, 2]
    for a, b in zip(once.orderBy("block").collect(), twice.orderBy("block").collect()):
        assert a.met == b.met and np.allclose(np.frombuffer(a.change, np.float16), np.frombuffer(b.change, np.float16), atol=1e-2)


# media


def picture(seed, side=128):
    r = np.random.default_rng(seed)
    x = media.resized(r.normal(size=(1, 16, 16)).astype("f4"), side / 16)[0] + 0.5 * media.resized(r.normal(size=(1, 32, 32)).astype("f4"), side / 32)[0]
    return 128 + 40 * (x - x.mean()) / x.std()


EDITS = [lambda x: x * 0.8 + 20, lambda x: x[12:116, 8:120], lambda x: np.rot90(x), lambda x: x + np.random.default_rng(1).normal(0, 3, x.shape), lambda x: np.rot90(x)[10:120, 10:120]]


def test_media_finds_copies_and_leaves_the_rest(spark):
    rows, expected = [], {}
    for k in range(12):
        base = picture(k)
        for j, image in enumerate([base, base] + [e(base) for e in EDITS]):
            rows.append((100 * k + j, media.encode_pgm(image), k))
            expected[100 * k + j] = 100 * k
    rows += [(9000, None, 0), (9001, b"", 0), (9002, b"P5 9 9", 0), (9003, media.encode_pgm(np.full((64, 64), 7.0)), 0), (None, media.encode_pgm(picture(5)), 0)]
    df = spark.createDataFrame(rows, "id bigint, data binary, corners int")
    got = {r.id: r.component_id for r in media.find_copies(df, id_col="id", media_col="data").collect()}
    assert got[None] is None and all(got[k] == k for k in range(9000, 9004))
    right = sum(got[k] == v for k, v in expected.items())
    assert right / len(expected) >= 0.9
    assert not any(got[a] == got[b] for a in expected for b in expected if expected[a] != expected[b] and a < b)
    assert media.find_copies(df.filter("id < 0"), id_col="id", media_col="data").count() == 0


def test_media_recall_of_candidates_against_all_pairs(spark):
    """Links by table and consensus, against consensus over all pairs of descriptors within BANDS - 1 bits."""
    images = [e(picture(50 + k)) for k in range(6) for e in (lambda x: x, *EDITS)]
    owned = [media.describe(np.stack([media.decode(media.encode_pgm(i))]))[1:] for i in images]
    brute = set()
    for a in range(len(images)):
        for b in range(a):
            bits = (owned[a][1][:, None] ^ owned[b][1][None]).astype(np.uint32)
            near = np.bitwise_count(bits).sum(2) < media.BANDS
            m = [np.concatenate([owned[a][0][i], owned[b][0][j]]) for i, j in zip(*np.nonzero(near))]
            if len(m) >= media.MATCHES and media.consensus(np.array(m)) >= media.MATCHES:
                brute.add((b, a))
    df = spark.createDataFrame([(k, media.encode_pgm(i)) for k, i in enumerate(images)], "id bigint, data binary")
    got = {r.id: r.component_id for r in media.find_copies(df, id_col="id", media_col="data").collect()}
    assert brute and sum(got[a] == got[b] for a, b in brute) / len(brute) >= 0.9


def test_media_small_crops_of_large_pictures(spark):
    """Crops of 10 to 25 % of the area, and copies at a third of the size."""
    rows, expected = [], {}
    for k in range(6):
        base = picture(700 + k, 320) + 20 * media.resized(np.random.default_rng(k).normal(size=(1, 80, 80)).astype("f4"), 4)[0]
        crops = [base[100:220, 60:180], base[150:290, 150:300], media.resized(base[None].astype("f4"), 1 / 3)[0]]
        for j, image in enumerate([base, *crops]):
            rows.append((10 * k + j, media.encode_pgm(image)))
            expected[10 * k + j] = 10 * k
    got = {r.id: r.component_id for r in media.find_copies(spark.createDataFrame(rows, "id bigint, data binary"), id_col="id", media_col="data").collect()}
    assert sum(got[a] == got[b] for a, b in expected.items()) / len(expected) >= 0.9
    assert len({got[10 * k] for k in range(6)}) == 6


def test_media_memory_of_a_large_picture():
    import tracemalloc

    image = np.tile(picture(5, 256).astype("f4"), (12, 12))
    tracemalloc.start()
    owner, _, _ = media.describe(image[None])
    assert len(owner) > 10_000 and tracemalloc.get_traced_memory()[1] < 1500 << 20
    tracemalloc.stop()


def test_media_recall_on_the_querys_own_pictures(spark):
    """Crops, turns and changed brightness planted among 300 pictures rendered from the supplied vectors."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(300)
    own = [(r.vec_id, bytes(r.media)) for r in media.rendered(vectors).collect()]
    planted, edits = [], [lambda x: x * 0.9 + 8, lambda x: np.rot90(x), lambda x: x[4:64, 2:60], lambda x: np.rot90(x[2:62, 4:64], 2)]
    for k, (i, data) in enumerate(own[::20]):
        planted += [(10**6 + 10 * k + j, media.encode_pgm(e(media.decode(data))), i) for j, e in enumerate(edits)]
    df = spark.createDataFrame(own + [(i, d) for i, d, _ in planted], "id bigint, data binary")
    got = {r.id: r.component_id for r in media.find_copies(df, id_col="id", media_col="data").collect()}
    assert sum(got[i] == got[o] for i, _, o in planted) / len(planted) >= 0.9


def test_png_round_trip():
    import struct

    image = np.random.default_rng(2).integers(0, 255, (20, 17)).astype(np.uint8)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    for rule in range(5):
        lines = []
        for y in range(20):
            row = image[y].astype(int)
            left, up = np.concatenate([[0], row[:-1]]), image[y - 1].astype(int) if y else np.zeros(17, int)
            corner = np.concatenate([[0], up[:-1]])
            p = left + up - corner
            pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
            guess = [np.zeros(17, int), left, up, (left + up) // 2, paeth][rule]
            lines.append(bytes([rule]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 17, 20, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
        assert (media.decode(png) == image).all()


def test_media_recall_in_larger_groups(spark):
    """Twelve edited copies of each picture: nearly all keep their class."""
    edits = EDITS + [lambda x: x[20:120, 20:120] * 0.9, lambda x: np.rot90(x, 2), lambda x: np.rot90(x, 3) * 0.7 + 40, lambda x: media.resized(x[None].astype("f4"), 0.7)[0], lambda x: x[0:100, 0:110], lambda x: 255 - (255 - x) * 0.9]
    rows = [(100 * k + j, media.encode_pgm(e(picture(300 + k)))) for k in range(8) for j, e in enumerate([lambda x: x, *edits])]
    df = spark.createDataFrame(rows, "id bigint, data binary")
    got = [(r.id, r.component_id) for r in media.find_copies(df, id_col="id", media_col="data").collect()]
    assert sum(a // 100 * 100 == b for a, b in got) / len(got) >= 0.9


def test_media_hot_words_pair_all_holders_of_different_classes(spark):
    rows = [(7, i, 100 + i, i // 3 if i < 30 else i, 200) for i in range(200)] + [(8, i, i, 5, 20) for i in range(20)]
    words = spark.createDataFrame(rows, "word bigint, image bigint, p bigint, class bigint, n bigint")
    got = sorted((r.u, r.v, r.a, r.b) for r in media.every_pair_apart(words, "word").collect())
    of = {r[1]: r[3] for r in rows if r[0] == 7}
    assert got == [(u, v, 100 + u, 100 + v) for u in range(200) for v in range(u + 1, 200) if of[u] != of[v]]


def test_media_copies_that_share_only_hot_words_without_lead(spark, monkeypatch):
    """No word is rare, and neither a lead nor the next word may pair two images."""
    rows = [(100 * k + j, media.encode_pgm(e(picture(900 + k))), k) for k in range(3) for j, e in enumerate([lambda x: x, *EDITS])]
    monkeypatch.setattr(media, "HOLDERS", 1)
    monkeypatch.setattr(media, "with_lead", lambda words, *key: words.limit(0).selectExpr("image AS u", "image AS v", "p AS a", "p AS b"))
    df = spark.createDataFrame(rows, "id bigint, data binary, k int")
    got = {r.id: r.component_id for r in media.find_copies(df, id_col="id", media_col="data").collect()}
    together = [got[i] == 100 * k for i, _, k in rows]
    assert sum(together) >= 0.9 * len(together), got


def test_media_every_match_proposes():
    r = np.random.default_rng(1)
    noise = np.repeat(r.uniform(0, 4000, (60, 8)) * [1, 1, 0, 0, 1, 1, 0, 0] + [0, 0, 1, 0, 0, 0, 1, 0], 5, 0)
    noise[:, :2] += r.uniform(0, 0.5, (300, 2))
    at = np.arange(30)[:, None] * [37.0, 53.0]
    angle = np.linspace(-3, 3, 30)  # the turn that each proposes is wrong but for the first
    true = np.concatenate([at, np.ones((30, 1)), np.zeros((30, 1)), at + 5000, np.ones((30, 1)), angle[:, None] * (np.arange(30) > 0)[:, None]], 1)
    assert media.consensus(np.concatenate([noise, true])) >= 25


def test_media_blocks_find_the_links_of_every_pair_apart(spark, monkeypatch):
    """Links of blocks equal consensus over all pairs, and nothing but the images themselves is shuffled."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(70)
    own = [(r.vec_id, bytes(r.media)) for r in media.rendered(vectors).collect()]
    own += [(10**6 + k, media.encode_pgm(np.rot90(media.decode(d))[4:60, 2:62])) for k, (_, d) in enumerate(own[:6])]
    own += [(2 * 10**6 + k, media.encode_pgm(e(picture(40)))) for k, e in enumerate([lambda x: x, *EDITS])]  # over 64 squares
    found = media.corners(spark.createDataFrame(own, "id bigint, media binary")).selectExpr("id AS image", "pmod(id, 9) AS class", "places", "words")
    rows = [r.asDict() for r in found.collect()]
    expected = set()
    for x in rows:
        by = {}
        for k, w in enumerate(x["words"]):
            by.setdefault((k % media.BANDS, w), []).append(x["places"][k // media.BANDS])
        x["by"] = by
    for x in rows:
        for y in rows:
            if x["image"] < y["image"] and x["class"] != y["class"]:
                m = list({(p, q) for w in x["by"].keys() & y["by"].keys() for p in x["by"][w] for q in y["by"][w]})
                if len(m) >= media.MATCHES:
                    m = np.concatenate([media.unpacked(np.array([k[side] for k in m])) for side in (0, 1)], 1)
                    least = media.MATCHES + media.by_chance(m) + media.CHANCE * media.by_chance(m) ** 0.5
                    if media.consensus(m, least) >= least:
                        expected.add((x["image"], y["image"]))
    for block, pairs in ((2000, 128), (20, 0), (7, 10**9)):
        monkeypatch.setattr(media, "BLOCK", block)
        monkeypatch.setattr(media, "PAIRS", pairs)
        df = media.links_apart(found)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got = [(r.u, r.v) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 10
    assert media.links_apart(found.limit(0)).count() == 0


def test_media_compared_sorts_each_match_once(monkeypatch):
    r = np.random.default_rng(8)
    word = r.integers(0, 40, (60, 12, media.BANDS)).astype(np.int32)
    places = media.packed(np.concatenate([r.uniform(10, 50, (720, 2)), np.ones((720, 1)), r.uniform(0, 6, (720, 1))], 1)).reshape(60, 12)
    rows = [{"image": 100 - k, "class": k % 7, "places": places[k], "words": word[k].ravel()} for k in range(60)]
    a, b = media.side_of(rows[:25]), media.side_of(rows[25:])
    monkeypatch.setattr(media, "promising", lambda a, b: np.ones((len(a["image"]), len(b["image"])), bool))
    monkeypatch.setattr(media, "may_agree", lambda p, q, cuts: np.ones(len(cuts), bool))
    monkeypatch.setattr(media.np, "unique", None)  # takes longer than all the rest
    got = {(u, v): sorted(map(tuple, m.tolist())) for u, v, m in media.compared(a, b)}
    monkeypatch.undo()
    expected = {}
    for x in range(25):
        for y in range(25, 60):
            m = [(i, j) for i in range(12) for j in range(12) if (word[x][i] == word[y][j]).any()]
            if x % 7 != y % 7 and m:
                at = [np.concatenate([media.unpacked(places[[y, x][k]][[j, i][k]]) for k in (0, 1)]) for i, j in m]  # the smaller id first
                expected[100 - y, 100 - x] = sorted(tuple(v.tolist()) for v in at)
    assert got == expected and len(got) > 700


def test_media_a_hot_word_gives_one_match_for_each_holder(spark, monkeypatch):
    """What is shuffled before the blocks grows with the holders of a hot word; they are not dealt and paired anew."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(120)
    own = [(r.vec_id, bytes(r.media)) for r in media.rendered(vectors).collect()]
    df = spark.createDataFrame(own, "id bigint, media binary")
    held = {}
    for r in media.corners(df).collect():
        for k, w in enumerate(r.words):
            held.setdefault((k % media.BANDS, w), []).append(r.id)
    hot = sum(len(x) - 1 for x in held.values() if len(x) > media.HOLDERS)
    few = sum(x[i] != x[j] for x in held.values() if len(x) <= media.HOLDERS for i in range(len(x)) for j in range(i))
    shuffled, gathered = [], media.gathered
    monkeypatch.setattr(media, "gathered", lambda matches: shuffled.append(matches.count()) or gathered(matches))
    assert media.find_copies(df, id_col="id", media_col="media").count() == len(own)
    assert hot > 1000 and few <= shuffled[0] <= few + hot


def test_media_words_are_dealt_once_for_their_classes(spark, monkeypatch):
    """Which images go to the blocks is told where the words are; these are not shuffled by image as well, nor joined."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").limit(60)
    plans, links_apart = [], media.links_apart
    monkeypatch.setattr(media, "links_apart", lambda images: plans.append(images._jdf.queryExecution().optimizedPlan().toString()) or links_apart(images))
    assert media.find_copies(media.rendered(vectors), id_col="vec_id", media_col="media").count() == 60
    assert len(plans) == 1 and plans[0].count("Join") == 1 and plans[0].count("Generate") == 1


def test_media_may_agree_passes_over_no_link(monkeypatch):
    """Pairs with planted copies of a few corners, some of them just enough: every link of ``consensus`` may agree, and few others."""
    r = np.random.default_rng(4)
    rows = []
    for k in range(80):
        at = np.concatenate([r.uniform(9, 55, (26, 2)), r.choice([1, 1 / 0.7, 1 / 0.49], (26, 1)), r.uniform(-3, 3, (26, 1))], 1)
        word = r.integers(0, 400, (26, media.BANDS))
        if k >= 40:  # some corners of another image, turned, with their words
            n, turn, old = 6 + k % 14, r.uniform(0, 6), rows[k - 40]
            z = (old["at"][:n, 0] - 32 + 1j * (old["at"][:n, 1] - 32)) * np.exp(1j * turn)
            at[:n] = np.stack([z.real + 32 + r.uniform(-1, 1, n), z.imag + 32 + r.uniform(-1, 1, n), old["at"][:n, 2], old["at"][:n, 3] + turn], 1)
            word[:n] = old["word"][:n]
        rows.append({"image": 500 - k, "class": k, "at": np.clip(at, [0, 0, 1, -10], 100), "word": word})
    for x in rows:
        x["places"], x["words"] = media.packed(x["at"]), x["word"].astype(np.int32).ravel()
    a, b = media.side_of(rows[:40]), media.side_of(rows[40:])

    def links():
        found = [(u, v, media.by_chance(m, len(m)), m) for u, v, m in media.compared(a, b)]
        return {(u, v) for u, v, c, m in found if media.consensus(m) >= media.MATCHES + c + media.CHANCE * c**0.5}, len(found)

    got, looked_at = links()
    for soon, gathered in ((0.5, 0), (100, 10**9)):
        monkeypatch.setattr(media, "SOON", soon)
        monkeypatch.setattr(media, "GATHERED", gathered)
        assert links()[0] == got
    monkeypatch.setattr(media, "promising", lambda a, b: np.ones((len(a["image"]), len(b["image"])), bool))
    monkeypatch.setattr(media, "may_agree", lambda p, q, cuts: np.ones(len(cuts), bool))
    expected, every = links()
    assert got == expected and len(got) >= 10 and every == 1600 and looked_at < 160, (len(got), every, looked_at)


def test_media_blocks_are_dealt_to_one_partition_each(spark):
    for blocks in (1, 6, 26, 64, 200):
        n = min(blocks, media.MOST_SEATS)
        dealt = media.seats(spark, blocks).repartition(n, "seat").withColumn("at", F.spark_partition_id()).collect()
        assert sorted(r.block for r in dealt) == list(range(blocks)) and len({r.seat for r in dealt}) == blocks
        assert max(Counter(r["at"] for r in dealt).values()) == -(-blocks // n)
