"""Personal data replaced by keyed surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, telephone, card and social security numbers, IBANs,
IPv4 addresses and names (after a title, or a known given name before a surname).  Each
entity is replaced through keyed permutations, so that equal entities get equal
surrogates everywhere (coreference) and different ones get different surrogates:

* digits go through a permutation of the numbers with as many places; separators, country
  codes, a card's first digit and the validity of check digits stay;
* letters and digits of words go through a two-way autokey cipher that keeps script, case,
  length and, in Latin, Greek and Cyrillic, the pattern of vowels and consonants;
* given names rotate within a list of one gender and script; titles stay;
* an IPv4 address stays in its private range, or public.

Every permutation P is used as the turn P^-1(P(x) + c) with c not 0, so no entity is ever its
own surrogate, and all of them depend on the key alone, never on the table: a row added
changes no surrogate.  An entity without a character that can be permuted (letters outside
``LETTERS`` and ``RANGES``) becomes a keyed hash.  Before anything is written, the distinct
entities of the whole table are checked; should two share a surrogate, which only hashes can,
the next salt of these hashes is taken.

The rewriting is row-local; the check shuffles distinct entities only, summed up before
the shuffle, so a hot entity is one row from each task.

Defined results: a null text stays null, an empty one empty, both with no entities;
repeated rows are rewritten each on its own; an empty table gives an empty result; all
other columns of ``replace`` pass through, whatever their names.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KEY = "tidemark-demonstration-key"
ROUNDS = 6
SALTS = 3
#: Longer words are ciphered in parts of so many characters.
PART = 64

#: Given names by script and gender.
GIVEN = {
    "latin_m": ["Aaron", "Adam", "Alan", "Albert", "Alejandro", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Brian", "Bruno", "Carlos", "Charles", "Christian", "Christopher", "Daniel", "David", "Diego", "Donald", "Edward", "Eric", "Ethan", "Fernando", "Francisco", "Frank", "François", "Frédéric", "Gary", "George", "Gregory", "Günter", "Hans", "Henry", "Jack", "Jacob", "Jacques", "James", "Jason", "Javier", "Jean", "Jeffrey", "John", "Jonathan", "Jorge", "José", "Joseph", "Joshua", "Juan", "Julien", "Jürgen", "Justin", "Kenneth", "Kevin", "Klaus", "Larry", "Lars", "Louis", "Luis", "Manuel", "Mark", "Markus", "Martin", "Matthew", "Michael", "Miguel", "Nicholas", "Nicolas", "Oliver", "Pablo", "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Ralf", "Richard", "Robert", "Ronald", "Ryan", "Samuel", "Scott", "Sebastian", "Stefan", "Stephen", "Steven", "Thomas", "Timothy", "Tobias", "Uwe", "Walter", "William", "Wolfgang"],
    "latin_f": ["Alice", "Amanda", "Amy", "Ana", "Andrea", "Angela", "Anna", "Barbara", "Beatriz", "Betty", "Birgit", "Brenda", "Brigitte", "Carmen", "Carol", "Caroline", "Catherine", "Charlotte", "Christine", "Claire", "Claudia", "Cynthia", "Deborah", "Diane", "Donna", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Françoise", "Greta", "Hannah", "Heidi", "Helen", "Ingrid", "Isabel", "Isabelle", "Jane", "Janet", "Jennifer", "Jessica", "Julia", "Julie", "Karen", "Karin", "Katherine", "Kathrin", "Kelly", "Laura", "Lisa", "Linda", "Lucía", "Margaret", "Maria", "Marie", "Marta", "Martina", "Mary", "Melissa", "Michelle", "Monika", "Nancy", "Nathalie", "Nicole", "Olivia", "Pamela", "Patricia", "Petra", "Rachel", "Rebecca", "Renate", "Rosa", "Ruth", "Sabine", "Samantha", "Sandra", "Sarah", "Sharon", "Silvia", "Sofia", "Sophie", "Stephanie", "Susan", "Sylvie", "Teresa", "Ursula", "Valérie", "Victoria"],
    "cyrillic_m": ["Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Пётр", "Сергей"],
    "cyrillic_f": ["Александра", "Анна", "Валентина", "Галина", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Татьяна"],
}
#: Titles that stay.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sra", "Господин", "Госпожа"]

VOWELS = "aeiouаеёиоуыэюяіїєαεηιουω"


class Alphabet(NamedTuple):
    """Letters and digits by class; a class's capitals stand in the order of its small letters."""

    letters: str
    first: list  # place of each letter's class, and how many are in it
    size: list


def alphabet(top: int = 0x590) -> Alphabet:
    """Digits, and the letters up to ``top`` by script, case, accents and, where known, vowel or consonant."""
    scripts = ["DIGIT", "ASCII", "LATIN", "CYRILLIC", "GREEK"]
    classes: dict[tuple, list[tuple[str, str]]] = {(0,): [(c, "") for c in "0123456789"]}
    for c in map(chr, range(top)):
        kind, low = unicodedata.category(c), c.lower()
        if kind not in ("Ll", "Lu", "Lo") or kind == "Lu" and len(low) == 1 and low.upper() == c:
            continue  # a capital comes with its small letter
        up = c.upper()
        paired = kind == "Ll" and len(up) == 1 and up != c and up.lower() == c
        script = "ASCII" if c < "\x80" else unicodedata.name(c, "").split(" ")[0]
        base = unicodedata.normalize("NFD", c)[0]
        sort = (base in VOWELS, base == c) if paired else (kind,)
        order = scripts.index(script) if script in scripts else len(scripts)
        classes.setdefault((order, script, paired, *sort), []).append((c, up if paired else ""))
    letters, first, size = "", [], []
    for _, pairs in sorted(classes.items()):
        for some in zip(*pairs):
            if "" not in some:
                first += [len(letters)] * len(some)
                size += [len(some)] * len(some)
                letters += "".join(some)
    return Alphabet(letters, first, size)


def runs(low: int = 0x590, top: int = 0x3100, least: int = 12) -> list[tuple[int, int]]:
    """(first code point, number) of the unbroken runs of letters without case, longest first."""
    out: list[tuple[int, int]] = []
    for o in range(low, top):
        if unicodedata.category(chr(o)) == "Lo":
            if out and sum(out[-1]) == o:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((o, 1))
    return sorted((r for r in out if r[1] >= least), key=lambda r: (-r[1], r[0]))


LETTERS = alphabet()
#: First code point and number of letters of the scripts with very many; the others by rule.
RANGES = [(0x4E00, 0x5200), (0x3400, 0x19C0), (0xAC00, 0x2BA4), (0xA000, 0x48D), (0x20000, 0xA6D7), *runs()]

#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: The private part of each first octet that is partly private: where it begins and its size.
PARTLY_PRIVATE = {100: (64 << 16, 1 << 22), 169: (254 << 16, 1 << 16), 172: (16 << 16, 1 << 20), 192: (168 << 16, 1 << 16)}
PUBLIC_OCTETS = [a for a in range(1, 224) if a not in (10, 127, *PARTLY_PRIVATE)]

RIGHT_EDGE = r"(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NAME_PART = r"\p{Lu}[\p{L}\p{M}'’-]+"
NUMBERS = "|".join(
    [
        rf"(?<!\.)(?:{OCTET}\.){{3}}{OCTET}(?!\.?[\p{{L}}\p{{N}}])",
        rf"(?<!\+)\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}{RIGHT_EDGE}",
        rf"\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}{RIGHT_EDGE}",
        rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{RIGHT_EDGE}",
        rf"[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}{RIGHT_EDGE}",
        rf"(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}){RIGHT_EDGE}",
    ]
)
CAPITALS = "|".join(
    [
        rf"[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){RIGHT_EDGE}",
        rf"(?:{'|'.join(TITLES)})\.? {NAME_PART}(?: {NAME_PART})?",
        rf"(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {NAME_PART}",
    ]
)
#: All begin where no letter or digit stands before; the first character says which can follow.
PATTERN = (
    r"(?<![\p{L}\p{N}])(?:"
    r"(?<![._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]+(?:(?:\.[\p{L}\p{M}\p{N}-]++){31,}+|(?:\.[\p{L}\p{M}\p{N}-]+){0,30}\.\p{L}{2,})"
    rf"|(?=[0-9+(])(?:{NUMBERS})|(?=\p{{Lu}})(?:{CAPITALS}))"
)
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "name")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def listed(values: list) -> Column:
    """A list as a constant array of strings."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def noise(key: str, tag, *parts) -> Column:
    """A keyed number under 2**60."""
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, *parts), 256), 1, 15), 16, 10).cast("long")


def turned(key: str, tag, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A permutation of pairs below (left_size, right_size) without fixed points: a Feistel network, a step, and back."""
    rounds = [(i, 1) for i in range(ROUNDS)] + [(ROUNDS, 1)] + [(i, -1) for i in reversed(range(ROUNDS))]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(sign).alias("sign")) for i, sign in rounds])

    def step(v: Column, r: Column) -> Column:
        drawn = noise(key, tag, r["i"], F.when(r["i"] == ROUNDS, "step").when(r["i"] % 2 == 1, v["r"].cast("string")).otherwise(v["l"].cast("string")))
        moved = F.when(r["i"] == ROUNDS, 1 + F.pmod(drawn, right_size - 1)).otherwise(r["sign"] * drawn)
        odd = (r["i"] != ROUNDS) & (r["i"] % 2 == 1)
        return F.struct(
            F.when(odd, F.pmod(v["l"] + moved, left_size)).otherwise(v["l"]).alias("l"),
            F.when(odd, v["r"]).otherwise(F.pmod(v["r"] + moved, right_size)).alias("r"),
        )

    return F.aggregate(each, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permuted_digits(key: str, tag: Column, digits: Column) -> Column:
    """Digits (two at least, 34 at most) to as many other digits, one to one."""

    def run(d: Column) -> Column:
        a, b = F.floor(F.length(d) / 2), F.ceil(F.length(d) / 2)
        size = lambda n: F.pow(F.lit(10.0), n).cast("long")
        pair = turned(key, F.concat_ws("|", tag, F.length(d)), d.substr(F.lit(1), a.cast("int")).cast("long"), d.substr((a + 1).cast("int"), b.cast("int")).cast("long"), size(a), size(b))
        return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a.cast("int"), F.lit("0")), F.lpad(p["r"].cast("string"), b.cast("int"), F.lit("0"))))

    return let(digits, lambda d: F.when(F.length(d) >= 2, run(d)).otherwise(d))


def only_digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def placed(e: Column, digits: Column) -> Column:
    """e with its digits replaced, in order, by those given."""
    return let(
        digits,
        lambda d: F.aggregate(
            F.split(e, ""),
            F.struct(F.lit("").alias("s"), F.lit(0).alias("k")),
            lambda acc, c: F.when(
                c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], d.substr(acc["k"] + 1, F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
            ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))),
            lambda acc: acc["s"],
        ),
    )


def luhn(body: Column) -> Column:
    """The check digit that makes body a valid number."""
    total = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.length(body)),
            lambda i: let(
                body.substr(F.length(body) + 1 - i, F.lit(1)).cast("int"),
                lambda x: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)),
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.pmod(-total, F.lit(10))


def number(key: str, kind: Column, e: Column) -> Column:
    """A telephone, card or social security number with its digits permuted, but for a country code and a card's ends."""

    def run(d: Column) -> Column:
        country = F.when(~e.startswith("+"), 0).when(d.rlike("^[17]"), 1).when(d.substr(1, 2).isin(*TWO_DIGITS), 2).otherwise(3)
        kept = F.when(kind == "phone", country).when(kind == "card", 1).otherwise(0)
        return let(F.struct(d.alias("d"), kept.alias("kept"), (F.length(d) - kept - (kind == "card").cast("int")).alias("n")), new)

    def new(v: Column) -> Column:
        moved = permuted_digits(key, kind, v["d"].substr(v["kept"] + 1, v["n"]))
        last = v["d"].substr(F.length(v["d"]), F.lit(1)).cast("int") - luhn(v["d"].substr(F.lit(1), F.length(v["d"]) - 1))
        body = F.concat(v["d"].substr(F.lit(1), v["kept"]), moved)
        return let(body, lambda b: F.when(kind == "card", F.concat(b, F.pmod(luhn(b) + last, F.lit(10)).cast("string"))).otherwise(b))

    return placed(e, let(only_digits(e), run))


def ip(key: str, e: Column) -> Column:
    """The first octet turns among the wholly public ones; the rest is permuted within its range."""
    whole = F.struct(F.lit(1 << 24).alias("start"), F.lit(0).alias("size"))
    octets = F.array(*[F.lit(a) for a in PUBLIC_OCTETS])

    def run(o: Column) -> Column:
        ranges = whole
        for a, (start, size) in PARTLY_PRIVATE.items():
            ranges = F.when(o[0] == a, F.struct(F.lit(start).alias("start"), F.lit(size).alias("size"))).otherwise(ranges)
        return let(F.struct(o.alias("o"), (o[1] * 65536 + o[2] * 256 + o[3]).alias("low"), ranges.alias("range")), placed_low)

    def placed_low(v: Column) -> Column:
        start, size, low = v["range"]["start"], v["range"]["size"], v["low"]
        private = (low >= start) & (low < start + size)
        rank = F.when(private, low - start).when(low < start, low).otherwise(low - size)
        room = F.when(private, size).otherwise((1 << 24) - size)
        pair = turned(key, F.concat_ws("|", F.lit("ip"), v["o"][0], private), F.floor(rank / 4096), rank % 4096, F.floor(room / 4096), F.lit(4096))
        back = lambda r: F.when(private, r + start).when(r < start, r).otherwise(r + size)
        first = F.pmod(F.array_position(octets, v["o"][0].cast("int")) + F.pmod(noise(key, "net"), F.lit(len(PUBLIC_OCTETS) - 1)), F.lit(len(PUBLIC_OCTETS)))
        first = F.when(v["o"][0].isin(*PUBLIC_OCTETS), F.element_at(octets, (first + 1).cast("int"))).otherwise(v["o"][0])
        return let(let(pair, lambda p: back(p["l"] * 4096 + p["r"])), lambda r: F.concat_ws(".", first, F.floor(r / 65536), F.floor(r / 256) % 256, r % 256))

    return let(F.transform(F.split(e, r"\."), lambda x: x.cast("long")), run)


def position(letters: str, c: Column) -> Column:
    """Place of c among the letters from 1; 0 if it is none of them."""
    return F.call_function("position", c, F.lit(letters))


def coded(s: Column) -> Column:
    """For each character c its class, of ``m`` members from ``first`` on, and its place x there; m is 1 where it has none."""
    ranges = sorted(RANGES)
    starts, counts = (F.transform(listed([r[k] for r in ranges]), lambda x: x.cast("int")) for k in (0, 1))

    def one(c: Column) -> Column:
        at, code = position(LETTERS.letters, c), F.ascii(c)
        last = F.size(F.filter(starts, lambda start: start <= code))
        near = lambda values, i: F.element_at(listed(values), i).cast("int")

        def place(v: Column) -> Column:
            table = F.struct(F.lit(False).alias("far"), near(LETTERS.first, v["at"]).alias("first"), near(LETTERS.size, v["at"]).alias("m"), (v["at"] - 1).alias("own"))
            far = F.struct(F.lit(True).alias("far"), F.element_at(starts, v["last"]).alias("first"), F.element_at(counts, v["last"]).alias("m"), v["code"].alias("own"))
            return F.when(v["at"] > 0, table).when(v["last"] > 0, far)

        def found(v: Column) -> Column:
            member = F.coalesce(v["own"] < v["first"] + v["m"], F.lit(False))
            return F.struct(
                c.alias("c"), v["far"].alias("far"), v["first"].alias("first"),
                F.when(member, v["m"]).otherwise(1).alias("m"), F.when(member, v["own"] - v["first"]).otherwise(0).alias("x"),
            )

        return let(let(F.struct(at.alias("at"), code.alias("code"), last.alias("last")), place), found)

    return F.transform(F.split(s, ""), one)


def decoded(t: Column, places: Column) -> Column:
    letters = F.split(F.lit(LETTERS.letters), "")

    def one(v: Column, x: Column) -> Column:
        far = F.decode(F.unhex(F.lpad(F.hex((v["first"] + x).cast("long")), 8, "0")), "UTF-32")
        return F.when(v["m"] == 1, v["c"]).when(v["far"], far).otherwise(F.element_at(letters, (v["first"] + x + 1).cast("int")))

    return F.array_join(F.zip_with(t, places, one), "")


def ciphered(key: str, tag: Column, s: Column) -> Column:
    """Letters and digits to others of their class, one to one, never all to themselves; the rest stays.

    Titles and given names are never given out: their turn passes on.
    """
    put = lambda x, n, m: F.pmod(x + n, m).cast("int")

    def there(x: Column, m: Column, way: Column) -> Column:
        """Each place moves by a keyed number drawn from those already moved."""
        step = lambda acc, v: F.concat(acc, F.array(put(v["x"], noise(key, way, F.array_join(acc, ",")), v["m"])))
        return F.aggregate(F.arrays_zip(x.alias("x"), m.alias("m")), F.array().cast("array<int>"), step)

    def back(y: Column, m: Column, way: Column) -> Column:
        step = lambda v, i: put(v["y"], -noise(key, way, F.array_join(F.slice(y, F.lit(1), i), ",")), v["m"])
        return F.transform(F.arrays_zip(y.alias("y"), m.alias("m")), step)

    def run(part: Column, i: Column) -> Column:
        forth, again = F.concat_ws("|", tag, i, F.lit("forth")), F.concat_ws("|", tag, i, F.lit("back"))

        def end(t: Column) -> Column:
            m = F.transform(t, lambda v: v["m"])
            z = let(there(F.transform(t, lambda v: v["x"]), m, forth), lambda y: there(F.reverse(y), F.reverse(m), again))
            return F.struct(t.alias("t"), m.alias("m"), F.reverse(m).alias("w"), z.alias("z"), F.lit(None).cast("string").alias("out"))

        def step(state: Column, _: Column) -> Column:
            m, w = state["m"], state["w"]
            moves = F.array_position(F.transform(w, lambda n: n > 1), True)  # of the characters that can move, the first one turns
            z = F.transform(state["z"], lambda x, i: F.when(i + 1 == moves, put(x, F.lit(1), F.element_at(w, i + 1))).otherwise(x))

            def moved(z: Column) -> Column:
                x = let(back(z, w, again), lambda y: back(F.reverse(y), m, forth))
                out = decoded(state["t"], x)
                return F.struct(state["t"].alias("t"), m.alias("m"), w.alias("w"), z.alias("z"), out.alias("out"))

            done = state["out"].isNotNull() & ((tag != "surname") | ~F.array_contains(listed(ALL_NAMES + TITLES), state["out"]))
            return F.when(done, state).otherwise(let(z, moved))

        turns = F.array(*[F.lit(k) for k in range(3)])
        return F.aggregate(turns, let(coded(part), end), step, lambda state: state["out"])

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), run), "")


ALL_NAMES = [n for names in GIVEN.values() for n in names]


def given(key: str, x: Column) -> Column:
    """A given name moved within its list; any other word stays."""
    sizes = [len(names) for names in GIVEN.values()]
    first = [sum(sizes[:k]) for k, n in enumerate(sizes) for _ in range(n)]
    size = [n for n in sizes for _ in range(n)]

    def run(at: Column) -> Column:
        start, n = (F.element_at(listed(values), at.cast("int")).cast("int") for values in (first, size))
        turn = 1 + F.pmod(noise(key, "given", start), n - 1)
        return F.when(at > 0, F.element_at(listed(ALL_NAMES), (start + F.pmod(at - 1 - start + turn, n) + 1).cast("int"))).otherwise(x)

    return let(F.array_position(listed(ALL_NAMES), x), run)


def words(key: str, kind: Column, e: Column) -> Column:
    """The words of an e-mail address, a name or an IBAN's body after their cipher."""
    domain = F.split(F.substring_index(e, "@", -1), r"\.")
    parts = (
        F.when(kind == "email", F.concat(F.array(F.substring_index(e, "@", 1)), domain))
        .when(kind == "iban", F.array(F.regexp_replace(e, " ", "").substr(5, 30)))
        .otherwise(F.transform(F.split(e, " "), lambda x: given(key, x)))
    )

    def run(all_parts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            stays = (i == F.size(all_parts) - 1) | F.lower(x).isin("example", "test", "invalid", "localhost")
            tag = (
                F.when(kind == "iban", "iban")
                .when(kind == "email", F.when(i == 0, "local").when(~stays, "domain"))
                .when(~F.array_contains(listed(ALL_NAMES + TITLES), F.regexp_replace(x, r"\.$", "")), "surname")
            )
            return let(tag, lambda t: F.when(t.isNull(), x).otherwise(ciphered(key, t, x)))

        return F.transform(all_parts, one)

    return let(parts, run)


def mod97(s: Column) -> Column:
    """An IBAN's rearranged characters as a number, modulo 97."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.aggregate(
        F.split(s, ""),
        F.lit(0),
        lambda a, c: let(position(digits, c) - 1, lambda v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97),
    )


def iban(e: Column, body: Column) -> Column:
    """The IBAN of e's country with another body, its check digits as right or wrong as before."""

    def run(c: Column) -> Column:
        country = c.substr(F.lit(1), F.lit(2))
        check = lambda b: 98 - mod97(F.concat(b, country, F.lit("00")))
        delta = c.substr(F.lit(3), F.lit(2)).cast("int") - check(c.substr(F.lit(5), F.lit(30)))
        return F.concat(country, F.lpad(F.pmod(check(body) + delta, F.lit(100)).cast("string"), 2, "0"), body)

    new = let(F.regexp_replace(e, " ", ""), run)
    return F.when(F.contains(e, F.lit(" ")), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)


def kind_of(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){8,31}$"), "iban")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"), "card")
        .when(e.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def surrogate(key: str, e: Column, salt: int = 0) -> Column:
    def of_kind(kind: Column) -> Column:
        email = lambda w: F.concat(w[0], F.lit("@"), F.array_join(F.slice(w, F.lit(2), F.size(w)), "."))
        spelt = lambda w: F.when(kind == "email", email(w)).when(kind == "iban", iban(e, w[0])).otherwise(F.array_join(w, " "))
        new = F.when(kind == "ip", ip(key, e)).when(kind.isin("phone", "card", "ssn"), number(key, kind, e)).otherwise(let(words(key, kind, e), spelt))
        hashed = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"hash {salt}"), e), 256), 1, 20)
        hashed = F.when(kind == "email", F.concat(hashed, F.lit("@"), F.substring_index(e, "@", -1))).otherwise(hashed)
        return let(new, lambda n: F.when(n == e, hashed).otherwise(n))

    return let(kind_of(e), of_kind)


def canonical(e: Column) -> Column:
    """What two mentions of one entity share."""
    kind = kind_of(e)
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind.isin("card", "ssn"), only_digits(e))
        .when(kind == "phone", F.regexp_replace(e, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .otherwise(e)
    )


MARK = "\x01"
PARTS = "tidemark pii parts"


def parts_of(text: Column) -> Column:
    """What stands between entities and the entities, in turn.

    One pass of the pattern marks the entities; a text that holds the mark itself takes two.
    """
    quick = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    pairs = F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, e: F.array(g, e)))
    return F.when(~F.contains(text, F.lit(MARK)), quick).otherwise(F.concat(pairs, F.slice(gaps, -1, 1)))


def entities_in(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def collisions(docs: DataFrame, key: str, *, text_col: str = "text", salt: int = 0) -> DataFrame:
    """Surrogates that stand for several entities, or that equal theirs: kind, surrogate, number of entities."""
    distinct = (
        docs.select(parts_of(F.col(text_col)).alias(PARTS))
        .select(F.explode(entities_in(F.col(PARTS))).alias("e"))
        .groupBy("e")
        .agg(F.lit(1).alias("one"))
        .groupBy(kind_of(F.col("e")).alias("kind"), canonical(F.col("e")).alias("entity"))
        .agg(F.min("e").alias("e"))
    )
    return (
        distinct.withColumn("surrogate", let(surrogate(key, F.col("e"), salt), canonical))
        .groupBy("kind", "surrogate")
        .agg(F.count("*").alias("n"), F.max(F.col("surrogate") == F.col("entity")).alias("same"))
        .filter((F.col("n") > 1) | F.col("same"))
        .select("kind", "surrogate", "n")
    )


def settled_salt(docs: DataFrame, key: str, *, text_col: str = "text") -> int:
    """The first salt without a collision over all the table's entities; it is 0 unless two hashes agree."""
    for salt in range(SALTS):
        if collisions(docs, key, text_col=text_col, salt=salt).isEmpty():
            return salt
    raise ValueError("two entities share a surrogate under every salt")


def joined(key: str, parts: Column, salt: int = 0) -> Column:
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, surrogate(key, x, salt)).otherwise(x)), "")


def replaced(key: str, text: Column, salt: int = 0) -> Column:
    return joined(key, parts_of(text), salt)


def replace(docs: DataFrame, *, key: str = KEY, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with every entity replaced; all columns stay, and ``count_col`` is the new text's length."""
    out = docs.withColumn(text_col, replaced(key, F.col(text_col), settled_salt(docs, key, text_col=text_col)))
    return out if count_col is None else out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    salt = settled_salt(docs, KEY)
    parts = docs.select("doc_id", parts_of(F.col("text")).alias(PARTS))
    rows = parts.select("doc_id", F.transform(entities_in(F.col(PARTS)), kind_of).alias("kinds"), joined(KEY, F.col(PARTS), salt).alias("text"))
    of = lambda w: F.filter("kinds", lambda k: k == w)
    return rows.select(
        "doc_id",
        F.coalesce(F.size("kinds"), F.lit(0)).cast("long").alias("n_entities"),
        *[F.coalesce(F.size(of(w)), F.lit(0)).cast("long").alias(f"n_{w}") for w in KINDS],
        "text",
    )
