"""Personal data by a semi-Markov conditional random field.

A segmentation of a stretch of tokens into typed segments scores the sum of weights of
features of whole segments (does the span look like an address, how many digits has it,
does a digit stand just outside) and of neighbouring types. Its probability is the exponential of
that, normalised over all segmentations. Training climbs the conditional likelihood by
the forward-backward recursion; decoding finds the best segmentation by dynamic
programming over ends, segment lengths up to ``MAX_LEN`` and types, so that boundaries and types are
chosen together.

Any tokens may be an entity. But if no token of a segment, nor of its neighbours, has a digit, an @, =, : or +, a secret's name or a row of capitals, few
features can hold of it, and ``quiet`` adds up the weights of all their combinations: where an entity there can't ever score more than tokens
outside, decoding needs to look only at the stretches around such tokens to find the best segmentation of the whole text, and texts
without one need not leave the JVM. Under weights of which that isn't so, everything is decoded. The weights are trained on made sentences by ``train`` and kept in pii_weights.json.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import random
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEN = 10  # an IBAN of 34 characters in groups has nine tokens
TYPES = ["O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "ID"]
WEIGHTS = Path(__file__).with_name("pii_weights.json")

TOKEN = re.compile(r"\S+")
TRIGGER_RE = r"[0-9@=:+]|(?i:passw|pwd|secret|token|key)|[A-Z]{17}"
TRIGGER = re.compile(TRIGGER_RE)
EMAIL = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+")
PHONE = re.compile(r"(\+\d{1,3}[ .\xa0-]?)?(\(\d{1,5}\)[ .\xa0-]?)?\d{1,5}([ .\xa0-]\d{2,5}){1,6}")
LONG = re.compile(r"\d{13,19}|\d{4}([ -]\d{4}){2,3}([ -]\d{1,4})?")
QUAD = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
KEY = re.compile(r"[A-Z]{3,5}[A-Z0-9]{14,}")
ACCESS = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}")
NAMED = re.compile(r"(?i)[\w-]*(password|passwd|pwd|secret|token|api_?key|key)[\w-]*\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?[^\w\s]*")
VALUE = re.compile(r"(?i)(.*?)([=:])\s*([\"']?)([^\s\"']+)[\"']?[^\w\s]*")
BLOB = re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
IBAN = re.compile(r"[A-Z]{2}\d{2}([A-Z0-9]{10,30}|([ \xa0-][A-Z0-9]{4}){2,7}([ \xa0-][A-Z0-9]{1,4})?)")
DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}")
VERSION = re.compile(r"v?\d+(\.\d+){0,2}")
OUTER = ".,;:!?\"')]}<>"


def bounds(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without punctuation around it."""
    while b > a and text[b - 1] in ".,;:!?)]}>" and not (text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    while a < b and text[a] in "[{<'":
        a += 1
    return a, b


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Names of the features of the segment of tokens i..j-1 that hold."""
    a, b = bounds(text, tokens[i][0], tokens[j - 1][1])
    s = text[a:b]
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    f = ["bias", f"len{j - i}"]
    # the others hold no blank
    for name, pattern in (("phone", PHONE), ("long", LONG), ("named", NAMED), ("iban", IBAN)) if j - i > 1 else (("email", EMAIL), ("phone", PHONE), ("long", LONG), ("key", KEY), ("access", ACCESS), ("named", NAMED), ("blob", BLOB), ("ssn", SSN), ("iban", IBAN), ("date", DATE), ("version", VERSION)):
        if pattern.fullmatch(s):
            f.append(name)
    if "named" in f:
        # the name, the sign, quotes and the value tell a secret from "key: word" together
        name, sign, quote, value = VALUE.fullmatch(s).groups()
        strong = "password" if re.search(r"(?i)passw|pwd|api_?key|secret_|_token|_key", name) else "name"
        size = "short" if len(value) < 10 else "long"
        f.append(f"named:{strong}{sign}{'quoted' if quote else ''}{size}{'digit' if re.search(r'[0-9]', value) else ''}")
    quad = QUAD.fullmatch(s)
    if quad:
        f.append("quad" if all(int(x) < 256 for x in quad.groups()) else "badquad")
    f.append("d0" if not n else "d1" if n < 7 else "d7" if n < 10 else "d10" if n < 13 else "d13")
    if 13 <= n <= 19 and luhn(digits):
        f.append("luhn")
    if "@" in s:
        f.append("at")
    if re.search(r"[^\W\d]", s):
        f.append("alpha")
    if s[:1] == "+":
        f.append("plus")
    if s[:1] == "0":
        f.append("zero")
    if s[:1] == "(":
        f.append("paren")
    for side, k in (("left", i - 1), ("right", j)):
        if 0 <= k < len(tokens):
            t = text[tokens[k][0] : tokens[k][1]]
            if re.fullmatch(r"[+(]?\d[\d().-]*", t) or re.fullmatch(r"\(\d+\)", t):
                f.append(side + "digits")
            if side == "left" and re.fullmatch(r"[=:]", t):
                f.append("lefteq")
            if side == "left" and re.fullmatch(r"(?i)[\w-]*(password|token|secret|key)[\w-]*[=:]?", t):
                f.append("leftname")
    return tuple(f)


def lattice(text: str, tokens: list[tuple[int, int]], whole: bool = True) -> list[list[tuple[int, tuple[str, ...]]]]:
    """For each end j: (start i, features); unless whole, of segments of several tokens only those that hold or touch a trigger."""
    hot = [whole or bool(TRIGGER.search(text, a, b)) for a, b in tokens]
    near = [any(hot[max(0, i - 1) : i + 2]) for i in range(len(tokens))]
    out = []
    for j in range(1, len(tokens) + 1):
        out.append([(i, span_features(text, tokens, i, j)) for i in range(max(0, j - MAX_LEN), j) if j - i == 1 or any(near[i:j])])
    return out


def quiet(model: Model) -> bool:
    """Whether segments without a trigger in or beside them never score more as an entity than outside."""
    kinds = range(len(TYPES))
    move = lambda a, b: 0.0 if a is None or b is None else model.w.get(f"{TYPES[a]}>{TYPES[b]}", 0.0)
    combine = lambda n: [("bias", f"len{n}", "d0", *(f for f, on in zip(("alpha", "paren"), bits) if on)) for bits in itertools.product((0, 1), repeat=2)]
    out = min(model.score(0, f) for f in combine(1))
    around = [None, *kinds]
    for k in kinds[1:]:
        for n in range(1, MAX_LEN + 1):
            best = max(model.score(k, f) - (n * out if n > 1 else model.score(0, f)) for f in combine(n))
            if max(best + move(p, k) + move(k, q) - move(p, 0) - (n - 1) * move(0, 0) - move(0, q) for p in around for q in around) > 0:
                return False
    return True


class Model:
    def __init__(self, weights: dict[str, float]):
        self.w = weights
        self.known: dict[tuple[str, ...], list[tuple[int, float]]] = {}
        self._calm: bool | None = None

    def calm(self) -> bool:
        """:func:`quiet`, worked out once."""
        if self._calm is None:
            self._calm = quiet(self)
        return self._calm

    def score(self, kind: int, features: tuple[str, ...]) -> float:
        name = TYPES[kind]
        return sum(self.w.get(f"{name}|{f}", 0.0) for f in features)

    def segments(self, grid, known: dict | None = None) -> list[list[tuple[int, list[tuple[int, float]]]]]:
        """Scores of the segments: O is of one token. known: scores of sets of features met before."""
        known = {} if known is None else known
        out = []
        for j, row in enumerate(grid, 1):
            ends = []
            for i, f in row:
                if f not in known:
                    known[f] = [(k, self.score(k, f)) for k in range(len(TYPES))]
                ends.append((i, [x for x in known[f] if x[0] or j - i == 1]))
            out.append(ends)
        return out

    def decode(self, text: str, tokens: list[tuple[int, int]], whole: bool = True) -> list[tuple[int, int, int, float]]:
        """Entities (first token, end token, type, score above outside) of the best segmentation; of equal ones the shortest last segments, of the first type."""
        n, grid = len(tokens), lattice(text, tokens, whole)
        seg = self.segments(grid, self.known)
        out_one = [next(v for i, s in row if i == j - 1 for k, v in s if k == 0) for j, row in enumerate(seg, 1)]
        best = [{-1: (0.0, None)}] + [{} for _ in range(n)]
        for j in range(1, n + 1):
            for i, scores in reversed(seg[j - 1]):
                for k, v in scores:
                    top = None
                    for prev, (u, _) in best[i].items():
                        t = u + v + (self.w.get(f"{TYPES[prev]}>{TYPES[k]}", 0.0) if prev >= 0 else 0.0)
                        if top is None or t > top[0]:
                            top = (t, (i, prev, k, v))
                    if top and (k not in best[j] or top[0] > best[j][k][0]):
                        best[j][k] = top
        found, j = [], n
        k = max(best[n], key=lambda x: best[n][x][0])
        while j > 0:
            _, (i, prev, kind, v) = best[j][k]
            if kind:
                found.append((i, j, kind, v - sum(out_one[i:j])))
            j, k = i, prev
        return found[::-1]


def _log_add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def made_sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with marked entities (start, end, type) among words and harmless numbers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ü", "sch", "que", "ción"]) for _ in range(r.randint(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    low = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    pairs = lambda k, sign=" ": sign.join(num(2) for _ in range(k))

    def grouped() -> str:
        """An IBAN in groups of four."""
        country, size = r.choice([("DE", 22), ("FR", 27), ("ES", 24), ("GB", 22), ("NL", 18), ("MT", 31)])
        body = country + num(2) + (low(4).upper() if country in ("GB", "NL", "MT") else "")
        body += num(size - len(body))
        return " ".join(body[k : k + 4] for k in range(0, size, 4))

    def undigited() -> list[str]:
        name = r.choice(["password", "passwd", "PWD", "db_password", "api_key", "apikey", "secret_key", "access_token"])
        value = r.choice([low(r.randint(6, 9)), low(r.randint(10, 24)), low(r.randint(10, 24))])
        return [f"{name}={value}", f"{name}: {value}", f'{name} = "{value}"', f"{r.choice(['token', 'secret', 'key'])}{r.choice(['=', ': ', ' = '])}{low(r.randint(12, 28))}", "AKIA" + low(16).upper()]

    def entity() -> tuple[str, str]:
        kind = r.choice(TYPES[1:])
        if kind == "EMAIL":
            return kind, f"{word()}{r.choice(['', '.', '_'])}{num(r.randint(0, 2))}@{r.choice(['mail', 'post', 'x-y'])}{num(r.randint(0, 1))}.{r.choice(['example.com', 'org', 'co.uk'])}"
        if kind == "PHONE":
            return kind, r.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)}-{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+33 {num(1)} {pairs(4)}", f"+33 (0) {num(1)} {pairs(4)}", f"0{num(1)} {pairs(4)}", f"0{num(1)}.{pairs(4, '.')}", f"+34 {num(3)} {pairs(3)}", f"+49 {num(2)} {num(4)} {pairs(2)}", f"0{num(3)} {num(6)}"])
        if kind == "CARD":
            return kind, r.choice([num(16), num(16), num(15), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"])
        if kind == "IP":
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "SECRET":
            return kind, r.choice(["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(14)) + r.choice("234567") + "Q", f"password={hexa(16)}1f", f'token = "{hexa(39)}7"', f"api_key={hexa(18)}9c", f"secret: {hexa(24)}0a", *undigited()])
        return kind, r.choice([f"{num(3)}-{num(2)}-{num(4)}", f"{r.choice(['DE', 'FR', 'ES'])}{num(20)}", grouped()])

    def harmless() -> str:
        return r.choice([num(r.randint(1, 6)), f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"{r.randint(1, 3)}.", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", f"${num(3)}.{num(2)}", f"{num(2)}%", f"{num(2)}:{num(2)}", f"{r.randint(1990, 2020)}-{r.randint(1990, 2020)}", f"@{word()}", f"{num(3)},{num(3)}", f"({num(1)})", f"({num(4)})", f"{word()}:", f"{word()}: {word()}", f"{word()}={word()}", f"http://{low(6)}.org/{low(5)}", f"https://{low(12)}.example.com/", f"{r.choice(['key', 'secret', 'token', 'password', 'keyboard', 'tokens'])}", f"{r.choice(['key', 'secret', 'token'])}: {low(r.randint(2, 8))}", f"{low(3)}::{low(5)}", low(18).upper(), " ".join(str(r.randint(1, 99)) for _ in range(r.randint(3, 9))), " ".join(str(r.randint(100, 9999)) for _ in range(r.randint(2, 6))), f"{low(2).upper()}{num(2)} {num(1)}", "COVID-19", f"A{num(1)}", f"{num(1)}th", f"{num(2)} {num(2)}"])

    out = []
    for _ in range(n):
        text, marks = "", []
        for _ in range(r.randint(3, 7)):
            p = r.random()
            piece, kind = (word(), None)
            if p < 0.35:
                kind, piece = entity()
            elif p < 0.55:
                piece = harmless()
            if text:
                text += " "
            if kind:
                marks.append((len(text), len(text) + len(piece), kind))
            text += piece
            text += r.choice(["", "", "", ".", ","])
        out.append((text, marks))
    return out


def train(n: int = 400, epochs: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Model:
    """Maximises the conditional likelihood of made sentences by stochastic AdaGrad."""
    data = []
    for text, marks in made_sentences(n, seed):
        tokens = [m.span() for m in TOKEN.finditer(text)]
        gold, at = [], 0
        ends = {a: (b, kind) for a, b, kind in marks}
        while at < len(tokens):
            if tokens[at][0] in ends:
                b, kind = ends[tokens[at][0]]
                j = at + 1
                while j < len(tokens) and tokens[j][0] < b:
                    j += 1
                gold.append((at, j, TYPES.index(kind)))
                at = j
            else:
                gold.append((at, at + 1, 0))
                at += 1
        data.append((lattice(text, tokens), gold))
    w: dict[str, float] = {}
    seen: dict[str, float] = {}
    order = random.Random(seed)
    model = Model(w)
    kinds = range(len(TYPES))
    for _ in range(epochs):
        order.shuffle(data)
        for grid, gold in data:
            size = len(grid)
            seg = model.segments(grid)
            move = [[w.get(f"{TYPES[a]}>{TYPES[b]}", 0.0) for b in kinds] for a in kinds]
            alpha = [[-math.inf] * len(TYPES) for _ in range(size + 1)]
            into = {}
            for j in range(1, size + 1):
                for i, scores in seg[j - 1]:
                    for k, v in scores:
                        if i == 0:
                            u = 0.0
                        else:
                            u = -math.inf
                            for p in kinds:
                                u = _log_add(u, alpha[i][p] + move[p][k])
                        into[i, j, k] = u + v
                        alpha[j][k] = _log_add(alpha[j][k], u + v)
            z = -math.inf
            for k in kinds:
                z = _log_add(z, alpha[size][k])
            beta = [[-math.inf] * len(TYPES) for _ in range(size + 1)]
            beta[size] = [0.0] * len(TYPES)
            grad: dict[str, float] = {}
            for j in range(size, 0, -1):
                for i, scores in seg[j - 1]:
                    features = next(f for s, f in grid[j - 1] if s == i)
                    for k, v in scores:
                        p = math.exp(min(0.0, into[i, j, k] + beta[j][k] - z))
                        if p > 1e-6:
                            for f in features:
                                grad[f"{TYPES[k]}|{f}"] = grad.get(f"{TYPES[k]}|{f}", 0.0) - p
                        if i:
                            for q in kinds:
                                u = move[q][k] + v + beta[j][k]
                                beta[i][q] = _log_add(beta[i][q], u)
                                t = alpha[i][q] + u - z
                                if t > -14:
                                    grad[f"{TYPES[q]}>{TYPES[k]}"] = grad.get(f"{TYPES[q]}>{TYPES[k]}", 0.0) - math.exp(min(0.0, t))
            before = None
            for i, j, k in gold:
                for f in next(f for s, f in grid[j - 1] if s == i):
                    grad[f"{TYPES[k]}|{f}"] = grad.get(f"{TYPES[k]}|{f}", 0.0) + 1
                if before is not None:
                    grad[f"{TYPES[before]}>{TYPES[k]}"] = grad.get(f"{TYPES[before]}>{TYPES[k]}", 0.0) + 1
                before = k
            for name, g in grad.items():
                g -= decay * w.get(name, 0.0)
                seen[name] = seen.get(name, 0.0) + g * g
                w[name] = w.get(name, 0.0) + rate * g / math.sqrt(seen[name] + 1e-8)
    return Model({k: round(v, 4) for k, v in sorted(w.items()) if abs(v) > 1e-3})


def load() -> Model:
    return Model(json.loads(WEIGHTS.read_text()))


def find(model: Model, text: str) -> list[tuple[int, int, str, float]]:
    """Entities of a text: (start, end, type, score), in characters."""
    calm = model.calm()
    if calm and not TRIGGER.search(text):
        return []
    out: list[tuple[int, int, str, float]] = []
    # stretches: all tokens whose segments may hold or touch a trigger, and one more on each side for context
    every = [m.span() for m in TOKEN.finditer(text)]
    begins = [a for a, _ in every]
    spans: list[list[int]] = []
    at = 0 if calm else len(text)
    if not calm and every:
        spans.append([0, len(every)])
    while m := TRIGGER.search(text, at):
        t = bisect.bisect_right(begins, m.start()) - 1
        at = every[t][1]
        first, end = max(0, t - MAX_LEN - 1), min(len(every), t + MAX_LEN + 2)
        if spans and first <= spans[-1][1]:
            spans[-1][1] = end
        else:
            spans.append([first, end])
    for a, b in spans:
        tokens = every[a:b]
        for i, j, kind, score in model.decode(text, tokens, not calm):
            s, e = bounds(text, tokens[i][0], tokens[j - 1][1])
            out.append((s, e, TYPES[kind], round(score, 4)))
    return out


def entities(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Entities in docs(doc_id, text): (doc_id, start, end, type, score), a row each, in characters from 0.

    score: how much the segment scores above leaving its tokens outside. Null and empty
    texts, and texts without entities, give no rows; null ids are carried; repeated rows are answered
    each. Between equal segmentations see :meth:`Model.decode`. Long texts cost in proportion to the stretches around triggers (see :func:`quiet`), which lose nothing. Empty table: no rows.
    """
    model = model or load()
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(TRIGGER_RE) if model.calm() else F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, e, kind, score) for d, t in zip(b.doc_id.array, b.text) for s, e, kind, score in find(model, t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "type", "score"])

    return slim.mapInPandas(run, "doc_id bigint, start bigint, end bigint, type string, score double")


def main() -> None:
    WEIGHTS.write_text(json.dumps(train().w, indent=0))


if __name__ == "__main__":
    main()
