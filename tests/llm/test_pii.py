"""Surrogates against a plain reading of the same rules in Python, and what must never leak."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

from .fixtures import documents, empty


def noise(*parts):
    return int(hashlib.sha256("|".join(map(str, (pii.KEY, *parts))).encode()).hexdigest()[:15], 16)


def turned(tag, left, right, left_size, right_size):
    rounds = [(i, 1) for i in range(pii.ROUNDS)] + [(None, 1)] + [(i, -1) for i in reversed(range(pii.ROUNDS))]
    for i, sign in rounds:
        if i is None:
            right = (right + 1 + noise(tag, pii.ROUNDS, "step") % (right_size - 1)) % right_size
        elif i % 2:
            left = (left + sign * noise(tag, i, right)) % left_size
        else:
            right = (right + sign * noise(tag, i, left)) % right_size
    return left, right


def digits(kind, d):
    a = len(d) // 2
    left, right = turned(f"{kind}|{len(d)}", int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a))
    return f"{left:0{a}d}{right:0{len(d) - a}d}"


def luhn(body):
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(body)))
    return -total % 10


def number(kind, e):
    d = re.sub("[^0-9]", "", e)
    country = 0 if e[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in pii.TWO_DIGITS else 3
    kept = {"phone": country, "card": 1, "ssn": 0}[kind]
    new = d[:kept] + digits(kind, d[kept : len(d) - (kind == "card")])
    if kind == "card":
        new += str((luhn(new) + int(d[-1]) - luhn(d[:-1])) % 10)
    there = iter(new)
    return "".join(next(there) if c in "0123456789" else c for c in e)


def place(c):
    if c in pii.LETTERS.letters:
        k = pii.LETTERS.letters.index(c)
        return pii.LETTERS.first[k], pii.LETTERS.size[k], k, False
    for start, n in pii.RANGES:
        if start <= ord(c) < start + n:
            return start, n, ord(c), True
    return 0, 1, 0, False


def part(tag, s):
    own = [place(c) for c in s]
    m, x = [n for _, n, _, _ in own], [k - f if n > 1 else 0 for f, n, k, _ in own]

    def there(x, m, way):
        out = []
        for v, n in zip(x, m):
            out.append((v + noise(f"{tag}|0|{way}", ",".join(map(str, out)))) % n)
        return out

    def back(y, m, way):
        return [(v - noise(f"{tag}|0|{way}", ",".join(map(str, y[:i])))) % n for i, (v, n) in enumerate(zip(y, m))]

    z = there(there(x, m, "forth")[::-1], m[::-1], "back")
    for _ in range(3):
        at = next((k for k, n in enumerate(m[::-1]) if n > 1), None)
        if at is not None:
            z[at] = (z[at] + 1) % m[::-1][at]
        y = back(back(z, m[::-1], "back")[::-1], m, "forth")
        out = "".join(c if n == 1 else chr(f + v) if far else pii.LETTERS.letters[f + v] for c, (f, n, _, far), v in zip(s, own, y))
        if tag != "surname" or out not in pii.ALL_NAMES + pii.TITLES:
            break
    return out


def name(e):
    out = []
    for x in e.split(" "):
        at = 0
        for names in pii.GIVEN.values():
            if x in names:
                x = names[(names.index(x) + 1 + noise("given", at) % (len(names) - 1)) % len(names)]
                break
            at += len(names)
        else:
            x = x if x.rstrip(".") in pii.TITLES else part("surname", x)
        out.append(x)
    return " ".join(out)


def email(e):
    local, domain = e.rsplit("@", 1)
    labels = domain.split(".")
    hidden = [x if k == len(labels) - 1 or x.lower() in ("example", "test", "invalid", "localhost") else part("domain", x) for k, x in enumerate(labels)]
    return part("local", local) + "@" + ".".join(hidden)


def ip(e):
    a, b, c, d = map(int, e.split("."))
    low, (start, size) = b * 65536 + c * 256 + d, pii.PARTLY_PRIVATE.get(a, (1 << 24, 0))
    private = start <= low < start + size
    rank, room = (low - start, size) if private else (low if low < start else low - size, (1 << 24) - size)
    left, right = turned(f"ip|{a}|{str(private).lower()}", rank // 4096, rank % 4096, room // 4096, 4096)
    rank = left * 4096 + right
    low = rank + start if private else rank if rank < start else rank + size
    if a in pii.PUBLIC_OCTETS:
        n = len(pii.PUBLIC_OCTETS)
        a = pii.PUBLIC_OCTETS[(pii.PUBLIC_OCTETS.index(a) + 1 + noise("net") % (n - 1)) % n]
    return f"{a}.{low // 65536}.{low // 256 % 256}.{low % 256}"


ENTITIES = {
    number: [("phone", "+1 (389) 555-5010"), ("phone", "(389) 555-5010"), ("phone", "+44 20 7946 0958"), ("phone", "+351 21 123 4567"), ("phone", "+998 (4567) 8901 2345 6789 0123 4567"), ("card", "4111 1111 1111 1111"), ("card", "4929348385146306"), ("ssn", "123-45-6789")],
    name: [(n,) for n in ("Mr Սարգսյան", "Dr Łęßź", "Mr Wu", "Dr Li", "Mrs. Maria Müller", "Kevin O'Brien", "Mrs İğşİ", "Анна Иванова", "Prof Παπαδόπουλος", "Dr D’Arc-Šímová")],
    email: [(e,) for e in ("jo.98@mail5.example.com", "JO.98@Mail5.example.com", "王小明@例子.中国", "حسن@موقع.com", "김@한국.kr", "a_b+c@x-1.co.uk", "ç@ç.fr")],
    ip: [(i,) for i in ("192.168.1.1", "172.16.0.9", "172.32.0.9", "169.254.1.1", "100.64.0.1", "100.63.0.1", "10.0.0.1", "127.0.0.1", "8.8.8.8", "224.0.0.1", "0.0.0.0", "192.0.2.1", "255.255.255.255")],
}


def test_surrogates_equal_a_plain_reading(spark):
    rows = [(rule(*args), args[-1]) for rule, some in ENTITIES.items() for args in some]
    df = spark.createDataFrame(rows, "expected string, text string")
    for r in df.select("expected", "text", pii.replaced(pii.KEY, F.col("text")).alias("got")).collect():
        assert r.got == r.expected != r.text


def test_addresses_stay_private_or_public(spark):
    import ipaddress

    rows = [f"{a}.{b}.7.{c}" for a in (1, 10, 100, 127, 169, 172, 192, 223) for b in (0, 15, 16, 31, 32, 63, 64, 127, 128, 167, 168, 169, 253, 254, 255) for c in (1, 200)]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    kinds = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16")]
    of = lambda t: next((n for n in kinds if ipaddress.ip_address(t) in n), None)
    got = df.select("text", pii.replaced(pii.KEY, F.col("text")).alias("new")).collect()
    assert all(of(r.text) == of(r.new) and r.text != r.new for r in got) and len({r.new for r in got}) == len(rows)


def test_no_entity_of_a_large_table_is_its_own_surrogate(spark):
    """All surnames of two letters, all numbers of four places, all addresses of one range: one to one, none left as it is."""
    names = spark.sql("SELECT concat('Mr ', char(65 + id div 26), char(97 + id % 26)) AS text FROM range(676)")
    phones = spark.sql("SELECT concat('+44 ', lpad(id div 100, 2, '0'), ' ', lpad(id % 100, 2, '0')) AS text FROM range(10000)")
    addresses = spark.sql("SELECT concat('169.254.', id div 256, '.', id % 256) AS text FROM range(20000)")
    df = names.unionByName(phones).unionByName(addresses)
    new = df.select("text", pii.replaced(pii.KEY, F.col("text")).alias("new"))
    r = new.agg(F.count("*").alias("n"), F.countDistinct("new").alias("distinct"), F.count_if(F.col("text") == F.col("new")).alias("same")).first()
    assert (r.n, r["distinct"], r.same) == (30676, 30676, 0)
    assert pii.collisions(df, pii.KEY).count() == 0


def test_a_row_added_changes_no_surrogate(spark):
    texts = ["mail jo@x.org", "Mr Wu and Dr Li", "call +1 389 555 5010"]
    alone = {r.text for r in pii.replace(documents(spark, texts)).collect()}
    more = {r.text for r in pii.replace(documents(spark, texts + [f"Mr {a}{b}" for a in "ABCDEFGH" for b in "abcdefgh"])).collect()}
    assert alone <= more
    assert pii.replace(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["+998 (4567) 8901 2345 6789 0123 456", "a@" + "x1." * 40 + "org"])
def test_long_entities_leave_nothing(spark, text):
    a, b = (r.text for r in pii.replace(documents(spark, [text + "7", text + "8"])).orderBy("doc_id").collect())
    assert a != b and a != text + "7"
    if "@" in text:
        assert "x1" not in a


def test_very_long_words(spark):
    text = "x" * 20_000 + "@" + "y" * 20_000 + ".com " + "+" * 50_000 + " 1" * 50_000
    new = pii.replace(documents(spark, [text])).first().text
    assert len(new) == len(text) and "xxxxx" not in new and "yyyyy" not in new
