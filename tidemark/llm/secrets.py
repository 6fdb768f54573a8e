"""Secret scan: fixed patterns plus a character convolutional network over candidates.

The patterns find assignments, access keys and hexadecimal runs.  Every run of token
characters (10 or more, with a digit, a sign or a change of case) is a candidate, those
that the patterns found as well: the network reads its characters and the text on both
sides and gives a calibrated probability.  A pattern's finding keeps its place whatever its
score; any other candidate, unless it lies within one, is a finding where its probability
reaches the threshold of its shape.

The network is trained on the driver, from a seed, on labelled findings that
``labelled_findings`` writes: secrets of public formats in the places they leak, and
look-alikes (hashes of commits, identifiers, paths, numbers, addresses, placeholders, words
with noise).  It is calibrated, and the thresholds are chosen so that recall stays at
``RECALL`` or more, on findings of other formats in other surroundings than those it was
trained on, one half each.  That cost is fixed; scoring is row-local and needs no shuffle.

Defined results: a null or empty text has no findings; repeated rows are judged each on
its own; an empty table gives an empty result; other columns are never read.  Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "cnn")

RUN = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{10,}")
MIXED = re.compile(r"[0-9!@#$%^&*]|[a-z][A-Z]")
#: What ends a sentence or is noise after a word is no part of a candidate.
TAIL = re.compile(r"(?:[.!]+|([%&*#$])\1\1+[.!]*)$")
LEAST = 10

LEFT, MIDDLE, RIGHT, STRIDE = 24, 64, 12, 48
WIDTH, EMBED, FILTERS, HIDDEN = 5, 12, 24, 16
RECALL = 0.98
EXAMPLES = 7000
#: Windows that are scored at once, however long a text or a candidate is.
WINDOWS = 4096

#: Character classes: 0 outside the text, 1-95 printable ASCII, 96 other ASCII, 97 the rest.
CLASSES = 98


def base_findings(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the fixed patterns, and the runs of token characters."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    runs = []
    for r in RUN.finditer(text):
        s, e = r.span()
        runs.append((s, e))
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, s, e) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, s, e) if m.end() - m.start() >= 16]
    return sorted(found), runs


CLASS_OF = np.array([o - 31 if 32 <= o <= 126 else 96 for o in range(128)], np.uint8)


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, CLASS_OF[np.minimum(codes, 127)], 97).astype(np.uint8)


def candidates(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for s, e in runs:
        tail = TAIL.search(text, max(s, e - 64), e)
        e = tail.start() if tail else e
        if e - s >= LEAST and MIXED.search(text, s, e):
            yield s, e


def encoded(classes: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
    """Windows over a candidate: left context, at most MIDDLE of its characters, right context.

    A longer candidate is read in overlapping windows to its end.
    """
    left, right = classes[max(0, start - LEFT) : start], classes[end : end + RIGHT]
    at = start
    while True:
        out = np.zeros(LEFT + MIDDLE + RIGHT, np.uint8)
        middle = classes[at : min(at + MIDDLE, end)]
        out[LEFT - len(left) : LEFT] = left
        out[LEFT : LEFT + len(middle)] = middle
        out[LEFT + MIDDLE : LEFT + MIDDLE + len(right)] = right
        yield out
        if at + MIDDLE >= end:
            return
        at += STRIDE


def shape(text: str, start: int, end: int) -> int:
    return 0 if end - start < 16 or re.search(r"[!@#$%^&*]", text[start:end]) else 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Network:
    """Embedding, one convolution, maxima over each segment, a hidden layer, one logit."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        n = WIDTH * (EMBED + 3)
        self.embed = r.normal(0, 0.3, (CLASSES, EMBED)).astype("f4")
        self.conv = r.normal(0, n**-0.5, (n, FILTERS)).astype("f4")
        self.conv_b = np.zeros(FILTERS, "f4")
        self.hid = r.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype("f4")
        self.hid_b = np.zeros(HIDDEN, "f4")
        self.out = r.normal(0, HIDDEN**-0.5, HIDDEN).astype("f4")
        self.out_b = np.zeros(1, "f4")
        self.scale, self.shift, self.thresholds = 1.0, 0.0, (0.5, 0.5)  # by shape

    NAMES = ("embed", "conv", "conv_b", "hid", "hid_b", "out", "out_b")
    SEGMENTS = ((0, LEFT), (LEFT, LEFT + MIDDLE), (LEFT + MIDDLE, LEFT + MIDDLE + RIGHT))

    def forward(self, x: np.ndarray) -> dict:
        b, t = x.shape
        marks = np.zeros((t, 3), "f4")
        for k, (s, e) in enumerate(self.SEGMENTS):
            marks[s:e, k] = 1
        v = np.concatenate([self.embed[x] * (x > 0)[..., None], np.broadcast_to(marks, (b, t, 3))], 2).astype("f4")
        pad = np.zeros((b, WIDTH // 2, EMBED + 3), "f4")
        v = np.concatenate([pad, v, pad], 1)
        cols = np.concatenate([v[:, i : i + t] for i in range(WIDTH)], 2)
        act = cols @ self.conv + self.conv_b
        tops = [act[:, s:e].argmax(1) + s for s, e in self.SEGMENTS]
        pooled = np.concatenate([np.take_along_axis(act, i[:, None], 1)[:, 0] for i in tops], 1)
        relu = np.maximum(pooled, 0)
        h = np.tanh(relu @ self.hid + self.hid_b)
        return {"x": x, "cols": cols, "tops": tops, "pooled": pooled, "relu": relu, "h": h, "z": h @ self.out + self.out_b[0]}

    def gradients(self, f: dict, y: np.ndarray) -> dict[str, np.ndarray]:
        b, t = f["x"].shape
        dz = ((1 / (1 + np.exp(-f["z"]))) - y).astype("f4") / b
        dh = dz[:, None] * self.out * (1 - f["h"] ** 2)
        dp = (dh @ self.hid.T) * (f["pooled"] > 0)
        g = {"out": f["h"].T @ dz, "out_b": dz.sum(keepdims=True), "hid": f["relu"].T @ dh, "hid_b": dh.sum(0)}
        conv = np.zeros_like(self.conv)
        dcols = np.zeros_like(f["cols"])
        rows = np.arange(b)
        for k, top in enumerate(f["tops"]):
            for j in range(FILTERS):
                d = dp[:, k * FILTERS + j]
                at = top[:, j]
                conv[:, j] += f["cols"][rows, at].T @ d
                dcols[rows, at] += d[:, None] * self.conv[:, j]
        g["conv"], g["conv_b"] = conv, dp.reshape(b, 3, FILTERS).sum((0, 1))
        dv = np.zeros((b, t + WIDTH - 1, EMBED + 3), "f4")
        for i in range(WIDTH):
            dv[:, i : i + t] += dcols[:, :, i * (EMBED + 3) : (i + 1) * (EMBED + 3)]
        de = dv[:, WIDTH // 2 : WIDTH // 2 + t, :EMBED].reshape(-1, EMBED)
        embed = np.zeros_like(self.embed)
        np.add.at(embed, f["x"].reshape(-1), de)
        embed[0] = 0
        g["embed"] = embed
        return g

    def logits(self, x: np.ndarray, rows: int = 512) -> np.ndarray:
        if not len(x):
            return np.zeros(0, "f4")
        return np.concatenate([self.forward(x[i : i + rows])["z"] for i in range(0, len(x), rows)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(x).astype("f8") + self.shift)


def labelled_findings(n: int, seed: int, other: bool = False) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n (text, start, end) with labels: 1 a secret, 0 a look-alike; ``other`` formats and surroundings, or those to train on."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    size = lambda lo, hi: int(r.integers(lo, hi))
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(len(alphabet), size=k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    any_case = lower + upper + digits
    hexes = digits + "abcdef"
    parts = ["the", "er", "tion", "ou", "an", "re", "ent", "lich", "que", "os", "ar", "in", "é", "ü", "ción", "st", "wh", "sh", "ble", "ung", "ment", "ado"]
    word = lambda hi=4: "".join(pick(parts) for _ in range(size(1, hi)))
    long_word = lambda: ("".join(pick(parts) for _ in range(size(4, 8))).replace("é", "e").replace("ü", "u").replace("ó", "o")).ljust(10, "a")
    prose = lambda k: " ".join(word() for _ in range(k)) + pick(["", ".", ","])
    uuid = lambda: "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12))
    noise = lambda: pick(["%%%", "&&&", "***", "###", "$$$"])
    names = ["horse", "battery", "staple", "dragon", "monkey", "summer", "winter", "london", "purple", "coffee", "silver", "tiger"]
    phrase = lambda: ("".join(pick(names) for _ in range(size(2, 4))) + chars(digits, size(1, 5)))
    hard = lambda: chars(any_case, size(4, 8)) + pick("!@#$%^&*") + chars(any_case + "!@#$%^&*", size(6, 12))
    word_of = ["password ", "pw ", "pass ", "passwd: ", "login ", "pwd: ", "passphrase ", "password is ", "pw was ", "pass: '", "user admin/", "secret is ", "key word: ", "login as "] if not other else ["the password is ", "pw is ", "my pass was ", "pwd = '", "credentials root/", "secret word: ", "login with "]
    secrets = [
        lambda: (pick(word_of), phrase()),
        lambda: (pick(word_of), hard()),
    ]
    if not other:
        secrets += [
            lambda: (pick(["key: ", "credentials = ", "auth=", "client_key = '", "Authorization: Bearer ", "access: ", "private_key=\"", "SECRET ", "passphrase "]), chars(any_case, size(18, 48))),
            lambda: (pick(["", "aws ", "id = ", "secret_access_key: "]), chars(any_case + "+/", 40)),
            lambda: (pick(["", "use ", "export GH=", "git clone https://"]), pick(["ghp_", "gho_", "ghs_"]) + chars(any_case, 36)),
            lambda: (pick(["", "stripe ", "key "]), pick(["sk_live_", "rk_live_", "sk_test_"]) + chars(any_case, 24)),
            lambda: (pick(["", "hook "]), "xoxb-" + chars(digits, 11) + "-" + chars(any_case, 24)),
            lambda: (pick(["", "Bearer ", "jwt "]), "eyJ" + chars(any_case, 20) + "." + "eyJ" + chars(any_case, 30) + "." + chars(any_case + "_-", 40)),
            lambda: (pick(["PRIVATE KEY-----\n", "KEY-----\n"]), "MII" + chars(any_case + "+/", 61)),
        ]
    else:
        secrets += [
            lambda: (pick(["Token ", "apikey ", "x-api-key: ", "--key ", "bearer: "]), chars(any_case, size(20, 44))),
            lambda: (pick(["", "maps ", "firebase "]), "AIza" + chars(any_case + "_-", 35)),
            lambda: (pick(["glpat=", "", "npm ", "registry "]), pick(["glpat-", "npm_", "pypi-", "ghu_"]) + chars(any_case + "_-", size(20, 40))),
            lambda: (pick(["", "mail "]), "SG." + chars(any_case + "_-", 22) + "." + chars(any_case + "_-", 43)),
            lambda: (pick(["key ", "pem "]), chars(any_case + "+/", 64)),
        ]
    benign = [
        lambda: (pick(["", prose(1) + " "]), long_word() + pick([noise(), "!!!", "", "2", "-" + word(2) + "1"])),
        lambda: (pick(["", "= "]), pick(["====", "----", "-.-.", "____", "****", "#-#-"]) * 6 + chars(digits, 1)),
        lambda: (pick(["", prose(1) + " "]), long_word() + noise() + pick(["", noise()]) + chars(lower, size(0, 3))),
    ]
    if not other:
        benign += [
            lambda: (pick(["commit ", "sha ", "merge ", "rev "]), chars(hexes, 40)),
            lambda: (pick(["id ", "uuid: ", "urn:", "session "]), uuid()),
            lambda: (pick(["/", "http://", "https://www.", "see "]), "/".join(word().encode("ascii", "ignore").decode() + chars(digits, size(0, 3)) for _ in range(4)).ljust(18, "a")),
            lambda: (pick(["", "card ", "no. ", "account "]), chars(digits, size(12, 22))),
            lambda: (pick(["", "version ", "on "]), f"{chars(digits, 4)}-{chars(digits, 2)}-{chars(digits, 2)}T{chars(digits, 6)}.{chars(digits, 3)}"),
            lambda: (pick(["key = ", "password: ", "api ", "auth="]), pick(["your_api_key_here1", "xxxxxxxxxxxxxxxx1", "changeme1changeme1", "EXAMPLE_KEY_000000", "replace-with-token-1", "0000000000000000"])),
            lambda: (pick(["base64,", "data:image/png;base64,"]), "iVBORw0KGgo" + chars(any_case + "+/", 60)),
            lambda: (pick(["file ", "in ", "module "]), "_".join(pick(["get", "set", "data", "value2", "test", "utils", "index", "main"]) for _ in range(4)).ljust(17, "1")),
            lambda: (pick(["mail ", "an ", "", "re."]), pick(["user", "info", "team", word(2).encode("ascii", "ignore").decode()]) + "." + chars(digits, 2) + "@mail" + chars(digits, 1) + ".example.com"),
            lambda: (pick(["", prose(1) + " "]), word(3).encode("ascii", "ignore").decode() + "o" + pick([".", "_", ""]) + chars(digits, size(0, 4)) + "@" + pick(["mail", "post", "x", word(2).encode("ascii", "ignore").decode() + "a"]) + chars(digits, size(0, 2)) + pick([".example", "", ".co"]) + pick([".com", ".org", ".de", ".fr", ".uk"])),
            lambda: (pick(["type ", "", "see "]), "".join(pick(["Image", "Local", "Index", "Query", "Base", "Thread", "Event"]) for _ in range(size(2, 5)))),
            lambda: (pick(["token ", "secret ", "pass ", "key: "]), pick(["your", "some", "my", "test", "demo", "PUT", "add"]) + pick(["-", "_"]) + pick(["token", "KEY", "secret", "value", "password"]) + pick(["-", "_"]) + pick(["here", "HERE", "goes", "1", "here123", "42"])),
            lambda: (prose(1) + " ", "".join(pick(["ther", "erse", "tion", "anoc", "ringe"]) for _ in range(5)) + pick(["2", "Ab", "7.5", "-X1"])),
            lambda: (pick(["const ", "new ", "class "]), "".join(pick(["Abstract", "Factory", "Handler", "Stream", "Window"]) for _ in range(3))),
            lambda: (pick(["at ", "from ", ""]), ".".join(str(size(1, 255)) for _ in range(4)) + pick(["", "/24", "-" + chars(digits, 2)])),
        ]
    else:
        benign += [
            lambda: (pick(["etag ", "digest ", "blob ", "HEAD is "]), chars(hexes, pick([32, 40, 64]))),
            lambda: (pick(["request ", "trace=", "{"]), uuid()),
            lambda: (pick(["www.", "ftp://", "path ", "from "]), ".".join(word().encode("ascii", "ignore").decode() + "x" for _ in range(4)).ljust(14, "b") + "/" + chars(digits, 4)),
            lambda: (pick(["tel ", "order ", "isbn "]), "-".join(chars(digits, k) for k in (3, 1, 4, 4, 1))),
            lambda: (pick(["", "built ", "tag "]), f"v{chars(digits, 1)}.{chars(digits, 2)}.{chars(digits, 2)}-rc{chars(digits, 1)}"),
            lambda: (pick(["token ", "password ", "pw: "]), pick(["INSERT_TOKEN_HERE_1", "************", "example1example1", "aaaaaaaaaaaa1", "dummy-value-123456"])),
            lambda: (pick(["contact ", "cc ", ""]), word(2).encode("ascii", "ignore").decode() + "a" + chars(digits, 2) + "@" + pick(["post", "corp", "web"]) + ".example.org"),
            lambda: (pick(["call ", "import ", "def "]), pick(["parse", "write", "open"]) + "_" + pick(["header", "table", "rows"]) + pick(["_v2", "_utf8", "_2nd"]).ljust(5, "x")),
            lambda: (pick(["", "type "]), "".join(pick(["Simple", "Default", "Remote", "Cache", "Node"]) for _ in range(3))),
        ]
    texts, labels = [], np.zeros(n, "f4")
    for k in range(n):
        labels[k] = k % 2
        lead, token = pick(secrets if k % 2 else benign)()
        tail = TAIL.search(token)
        end = tail.start() if tail and tail.start() >= LEAST else len(token)
        before = prose(size(0, 5))
        head = before + pick([" ", "\n", " | "]) + lead
        texts.append((head + token + pick([" ", "\n", '" ', "', ", ". ", "; "]) + prose(3), len(head), len(head) + end))
    return texts, labels


def windows_of(texts: list[tuple[str, int, int]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of every finding, and its label."""
    rows = [(w, y) for (text, s, e), y in zip(texts, labels) for w in encoded(classes_of(text), s, e)]
    return np.array([w for w, _ in rows]), np.array([y for _, y in rows], "f4")


def best_of(net: Network, texts: list[tuple[str, int, int]]) -> np.ndarray:
    """The largest logit of each finding's windows."""
    own = [np.array(list(encoded(classes_of(t), s, e))) for t, s, e in texts]
    z = net.logits(np.concatenate(own)).astype("f8")
    at = np.cumsum([0] + [len(o) for o in own[:-1]])
    return np.maximum.reduceat(z, at)


def trained(seed: int = 7, examples: int = EXAMPLES, epochs: int = 5) -> Network:
    """The network, trained on one kind of findings, calibrated and cut on two halves of the other kind."""
    x, y = windows_of(*labelled_findings(examples, seed))
    net = Network(seed)
    r = np.random.default_rng(seed + 1)
    m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
    step = 0
    for epoch in range(epochs):
        fit = r.permutation(len(x))
        for at in range(0, len(fit), 64):
            rows = fit[at : at + 64]
            g = net.gradients(net.forward(x[rows]), y[rows])
            step += 1
            for n in net.NAMES:
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                rate = 0.004 * 0.8**epoch * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(net, n, (getattr(net, n) - rate * m[n] / (np.sqrt(v[n]) + 1e-8)).astype("f4"))
    texts, labels = labelled_findings(examples // 2, seed + 100, other=True)
    half = len(texts) // 2
    z, t = best_of(net, texts[:half]), labels[:half]
    scale, shift = platt(z, t)
    net.scale, net.shift = float(scale), float(shift)
    p = sigmoid(scale * best_of(net, texts[half:]) + shift)
    kind = np.array([shape(*f) for f in texts[half:]])
    net.thresholds = tuple(recall_threshold(p[kind == k], labels[half:][kind == k] == 1) for k in (0, 1))
    return net


def platt(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make logits chances, by Newton steps that are halved until the loss falls."""
    n = t.sum()
    t = np.where(t > 0, (n + 1) / (n + 2), 1 / (len(t) - n + 2))  # targets a little inside 0 and 1
    loss = lambda a, b: float(np.logaddexp(0, a * z + b).sum() - (t * (a * z + b)).sum())
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        d, size = np.linalg.solve(h, g), 1.0
        while loss(a - size * d[0], b - size * d[1]) > loss(a, b) and size > 1e-6:
            size /= 2
        a, b = a - size * d[0], b - size * d[1]
        if size * abs(d).max() < 1e-6:
            break
    return a, b


def recall_threshold(p: np.ndarray, secret: np.ndarray) -> float:
    """Of the thresholds that keep recall at ``RECALL``, the one with the best F1."""
    best, out = -1.0, 0.5
    for at in np.unique(p[secret]):
        hit = (p >= at) & secret
        recall, precision = hit.sum() / secret.sum(), hit.sum() / (p >= at).sum()
        f1 = 2 * recall * precision / (recall + precision)
        if recall >= RECALL and f1 > best:
            best, out = f1, float(at)
    return out


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", net: Network | None = None) -> DataFrame:
    """One row for each document row: id and its findings (start, end, kind, score)."""
    net = net or trained()
    shipped = docs.sparkSession.sparkContext.broadcast({k: getattr(net, k) for k in (*net.NAMES, "scale", "shift", "thresholds")})
    df = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    ddl = f"`{id_col}` {df.schema[0].dataType.simpleString()}, spans array<struct<start:bigint,`end`:bigint,kind:string,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(0)
        vars(model).update(shipped.value)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [base_findings(t) for t in texts]
                scores = scored(model, ((k, s, e) for k, t in enumerate(texts) for s, e in candidates(t, found[k][1])), texts)
                rows = []
                for k, text in enumerate(texts):
                    base, own = found[k][0], scores.get(k, {})
                    spans = [(s, c, e, max((p for (a, b), p in own.items() if a < e and s < b), default=0.0)) for s, c, e in base]
                    for (s, e), p in own.items():
                        if p >= model.thresholds[shape(text, s, e)] and not any(a <= s and e <= b for a, _, b in base):
                            spans.append((s, 3, e, p))
                    rows.append([{"start": s, "end": e, "kind": KINDS[c], "score": p} for s, c, e, p in sorted(spans)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    return df.mapInArrow(scan, ddl)


def scored(model: Network, some: Iterable[tuple[int, int, int]], texts: list[str]) -> dict[int, dict[tuple[int, int], float]]:
    """For each text the probability of its candidates; at most ``WINDOWS`` windows are held at once."""
    out: dict[int, dict[tuple[int, int], float]] = {}
    windows, owners = [], []
    last, classes = -1, np.zeros(0, np.uint8)

    def flush() -> None:
        if windows:
            for (k, s, e), p in zip(owners, model.probability(np.array(windows)).tolist()):
                own = out.setdefault(k, {})
                own[s, e] = max(p, own.get((s, e), 0.0))
            windows.clear()
            owners.clear()

    for k, s, e in some:
        if k != last:
            last, classes = k, classes_of(texts[k])
        for w in encoded(classes, s, e):
            windows.append(w)
            owners.append((k, s, e))
            if len(windows) >= WINDOWS:
                flush()
    flush()
    return out


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(of("cnn")).cast("long").alias("n_cnn"),
    )


def digest(findings: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[c]}:{s}:{e}" for s, c, e in findings).encode()).hexdigest()
