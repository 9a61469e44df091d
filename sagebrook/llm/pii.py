"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field beside them.

The base spans are all matches of four patterns that pass their checks. The field reads the places
around digits and at-signs: it scores every segment of up to LONGEST pieces by features of the
whole span (its shape, its checks, its neighbours) for each type, and dynamic programming picks the
boundaries and types that are jointly likeliest. What it finds apart from base spans is added:
secrets, and phone numbers without a country code that are announced as such. It is trained on the
driver by the likelihood of a small table of sentences that a seeded rule writes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
TYPES = (*BASE, "secret")
LONGEST = 16
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[ \n]|\Z")
_PIECE = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_HEX = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}")
_LOCAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,4}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _passes(kind: str, text: str) -> bool:
    if kind == "ip":  # the length first: a part may be of any length
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    if kind == "card":
        if len(text) > 37:  # 19 digits with marks between them
            return False
        digits = text.replace(" ", "").replace("-", "")
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= sum("0" <= c <= "9" for c in text) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of _EMAIL. From each at-sign outwards, so that a long run of letters is read once,
    not once from each of its places."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL_PART:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            taken = domain.end()
            yield start, taken
        at = text.find("@", max(taken, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of _IP: four numbers after four in a run of dotted ones, which is read once."""
    if "." not in text:
        return
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            numbers = [(m.start(), m.end()) for m in _NUMBER.finditer(text, run.start(), run.end())]
            for i in range(3, len(numbers), 4):
                yield numbers[i - 3][0], numbers[i][1]


def _found(pattern: re.Pattern, needs: str):
    return lambda text: (m.span() for m in pattern.finditer(text)) if needs in text else ()


_FINDERS = (_emails, _ips, _found(_CARD, ""), _found(_PHONE, "+"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind) of all base matches, in order."""
    out = []
    if _SEED.search(text):
        for k, (kind, find) in enumerate(zip(BASE, _FINDERS, strict=True)):
            out += [(a, b, k) for a, b in find(text) if _passes(kind, text[a:b])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of neighbouring blank-separated tokens that hold a digit or an at-sign."""
    out: list[tuple[int, int]] = []
    at = 0
    while (seed := _SEED.search(text, at)) is not None:
        start = max(text.rfind(" ", at, seed.start()), text.rfind("\n", at, seed.start()), at - 1) + 1
        end = _BLANK.search(text, seed.start()).start()
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        at = end
    return out


def _kind_of(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else "q" if c in "\"'`" else c


@lru_cache(maxsize=20_000)
def _shape(start: str) -> str:
    """The shape of a segment that starts like this."""
    return re.sub(r"9+", "9", re.sub(r"a+", "a", "".join(map(_kind_of, start))))[:24]


def surroundings(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """What the features of text[start:end] are made from: itself, the characters beside it, and
    the announcing word before it."""
    word = _WORD_BEFORE.search(text, max(0, start - 24), start)
    word = word[1].lower() if word and word[1].lower() in _CUES else "-"
    return text[start:end], text[start - 1 : start], text[end : end + 1], word


def span_features(own: str, before: str, after: str, word: str) -> list[str]:
    """Features of a whole segment where it stands."""
    digits = sum("0" <= c <= "9" for c in own[:400])
    email, ip, card, phone = _EMAIL.fullmatch(own), _IP.fullmatch(own) and _passes("ip", own), _CARD.fullmatch(own) and _passes("card", own), _PHONE.fullmatch(own) and _passes("phone", own)
    check = "email" if email else "ip" if ip else "card" if card else "phone" if phone else "hex" if _HEX.fullmatch(own) else "local" if _LOCAL.fullmatch(own) else "none"
    edges = f"{_kind_of(before)}|{_kind_of(after)}"
    joined = before.isalnum() or after.isalnum() or before in "@.+-" and bool(before) or after == "@"
    return ["bias", f"shape={_shape(own[:60])}", f"check={check}", f"check={check},joined={joined}", f"check={check},word={word}", f"digits={min(digits, 20)}", f"edges={edges}", f"word={word}"]


#: Words that announce what follows; fixed values.
_CUES = frozenset("token secret key password apikey auth hash sha digest commit call phone tel telephone mobile fax card visa account mail email contact ip host server order version page since".split())


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """The pieces of a region, and its candidate segments as (first piece, piece after the last,
    start, end)."""
    pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, start, end)]
    out = []
    for i, (a, _) in enumerate(pieces):
        if not (text[a].isascii() and text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i, min(len(pieces), i + LONGEST)):
            b = pieces[j][1]
            c = text[b - 1]
            if not (c.isascii() and (c.isalnum() or c in " .-_%+@()")):
                break
            if c.isalnum() and _SEED.search(text, a, b):
                out.append((i, j + 1, a, b))
    return pieces, out


class Field:
    """Weights of (feature, type); decodes regions. Scores of the last short segments are kept."""

    KEPT, SHORT = 20_000, 64

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.kept: dict[tuple[str, str, str, str], np.ndarray] = {}

    def score(self, *around: str) -> np.ndarray:
        row = self.kept.get(around)
        if row is None:
            row = np.zeros(len(TYPES))
            for f in span_features(*around):
                row += self.weights.get(f, 0.0)
            if len(around[0]) <= self.SHORT:
                if len(self.kept) >= self.KEPT:
                    self.kept.clear()
                self.kept[around] = row
        return row

    def scores(self, text: str, found: list[tuple[int, int, int, int]]) -> np.ndarray:
        return np.array([self.score(*surroundings(text, a, b)) for _, _, a, b in found]).reshape(len(found), len(TYPES))

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        pieces, found = segments(text, start, end)
        if not found:
            return []
        scores = self.scores(text, found)
        kinds, values = scores.argmax(axis=1), scores.max(axis=1)
        ending: dict[int, list[int]] = {}
        for s in np.flatnonzero(values > 0).tolist():  # others never beat leaving their pieces out
            ending.setdefault(found[s][1], []).append(s)
        best, back = [0.0] * (len(pieces) + 1), [-1] * (len(pieces) + 1)
        for j in range(1, len(pieces) + 1):
            best[j] = best[j - 1]
            for s in ending.get(j, ()):
                if (v := best[found[s][0]] + values[s]) > best[j]:
                    best[j], back[j] = v, s
        out, j = [], len(pieces)
        while j:
            if back[j] < 0:
                j -= 1
            else:
                i, _, a, b = found[back[j]]
                out.append((a, b, int(kinds[back[j]])))
                j = i
        return out[::-1]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What it finds in a text that touches no base span."""
        spans = [s for a, b in regions(text) for s in self.decode(text, a, b)]
        out, k = [], 0
        base = sorted(base)
        reach = np.maximum.accumulate([e for _, e, _ in base]) if base else []
        starts = np.array([s for s, _, _ in base])
        for a, b, kind in spans:
            k = int(np.searchsorted(starts, b)) if base else 0
            if k == 0 or reach[k - 1] <= a:
                out.append((a, b, kind))
        return out


def sentences(seed: int = 20240509, n: int = 160) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences: by a seeded rule, personal data of every type and what only looks so."""
    rng = np.random.default_rng(seed)
    words = "the of and la de und der was on with for les que en es para nicht shore ention leaux ungen cion".split()

    def some(k: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def hexed(k: int) -> str:
        return "".join(rng.choice(list("0123456789abcdef"), k))

    def card(good: bool) -> str:
        body = str(rng.integers(3, 7)) + some(14)
        right = next(d for d in "0123456789" if luhn(body + d))
        full = body + (right if good else str((int(right) + int(rng.integers(1, 10))) % 10))
        return full if rng.random() < 0.6 else rng.choice([" ", "-"]).join(full[i : i + 4] for i in range(0, 16, 4))

    def pick(*of: str) -> str:
        return str(rng.choice(of))

    def ip(top: int) -> str:
        return ".".join(str(x) for x in (top, *rng.integers(0, 256, 3)))

    made = [
        lambda: ("", f"{pick(*words)}.{some(2)}@mail{some(1)}.example.{pick('com', 'org', 'net')}", 0),
        lambda: ("", f"{pick('a', 'info', 'j_smith')}{some(1)}@{pick(*words)}-host.co.uk", 0),
        lambda: ("", ip(int(rng.integers(1, 256))), 1),
        lambda: ("", card(True), 2),
        lambda: ("", f"+{rng.integers(1, 99)} ({some(3)}) {some(3)}-{some(4)}", 3),
        lambda: ("", f"+{rng.integers(1, 9)}{some(10)}", 3),
        lambda: (pick("call ", "phone: ", "tel. ", "mobile "), f"{pick('(', '')}{some(3)}-{some(3)}-{some(4)}".replace("(", ""), 3),
        lambda: (pick("tel ", "fax: "), f"({some(3)}) {some(3)}-{some(4)}", 3),
        lambda: (pick('token = "', 'secret: "', "key=", "password "), hexed(int(rng.choice([32, 40, 64]))), 4),
        lambda: ('token = "', hexed(40), 4),
        lambda: (pick("commit ", "sha ", "digest "), hexed(40), None),
        lambda: ("", card(False), None),
        lambda: ("", ip(int(rng.integers(256, 999))), None),
        lambda: (pick("version ", "since ", "page "), pick(f"{some(1)}.{some(1)}", f"20{some(2)}", some(3), f"{some(1)}.{some(1)}.{some(1)}"), None),
        lambda: ("", f"{some(3)}-{some(3)}-{some(4)}", None),
        lambda: ("", f"20{some(2)}-0{rng.integers(1, 9)}-1{some(1)}", None),
        lambda: ("", pick(hexed(8), some(12), f"@{pick(*words)}", f"{some(2)}%", f"order {some(10)}"), None),
    ]
    out = []
    for i in range(n):
        text, spans = "", []
        for k in rng.permutation(len(made))[: 1 + i % 3]:
            cue, thing, kind = made[k]()
            text += " ".join(rng.choice(words, 2)) + " " + cue
            if kind is not None:
                spans.append((len(text), len(text) + len(thing), kind))
            text += thing + pick(" ", ". ", '" ', "*** ", ", ", "!! ", " | ")
        out.append((text + pick(*words), spans))
    return out


@cache
def train() -> Field:
    """Weights of the greatest likelihood, with a penalty, by gradient steps over all sentences."""
    names: dict[str, int] = {}
    cases = []
    for text, spans in sentences():
        for start, end in regions(text):
            pieces, found = segments(text, start, end)
            if found:
                ids = np.array([[names.setdefault(f, len(names)) for f in span_features(*surroundings(text, a, b))] for _, _, a, b in found])
                gold = [(s, next((k for x, y, k in spans if (x, y) == (a, b)), -1)) for s, (_, _, a, b) in enumerate(found)]
                cases.append((len(pieces), found, ids, [(s, k) for s, k in gold if k >= 0]))
    w, square = np.zeros((len(names), len(TYPES))), np.full((len(names), len(TYPES)), 1e-8)
    for _ in range(40):
        slope = -0.02 * w
        for n, found, ids, gold in cases:
            scores = w[ids].sum(axis=1)
            top = np.logaddexp.reduce(scores, axis=1)
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0
            starting: dict[int, list[int]] = {}
            ending: dict[int, list[int]] = {}
            for s, (i, j, _, _) in enumerate(found):
                starting.setdefault(i, []).append(s)
                ending.setdefault(j, []).append(s)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[found[s][0]] + top[s] for s in ending.get(j, ()))])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[found[s][1]] + top[s] for s in starting.get(i, ()))])
            i, j = np.array([(x[0], x[1]) for x in found]).T
            expected = -np.exp(ahead[i][:, None] + scores + behind[j][:, None] - ahead[n])
            for s, k in gold:
                expected[s, k] += 1
            np.add.at(slope, ids.ravel(), np.repeat(expected, ids.shape[1], axis=0))
        square += slope * slope
        w += 0.5 * slope / np.sqrt(square)
    return Field({f: w[i] for f, i in names.items()})


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    return ",".join(f"{TYPES[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``
    (doc_id, text): the numbers of base spans of each kind, the SHA-256 of the list of base spans,
    and the list of all spans, those of the field included. Places are code points, ends exclusive.
    Null and empty texts have none. Repeated rows each get their row; other columns are ignored.
    """
    field = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text or "")
                    every = base + (field.value.added(text, base) if text else [])
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
                made = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind's name."""
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])):
        if a >= at:
            out += [text[at:a], f"[{TYPES[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with all spans in text masked, and n_chars, if there is one, as it is then. Null and
    empty texts, null ids, repeated rows and other columns stay as they are; of an empty table none."""
    field = spark.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column("text").to_pylist()
                for i, text in enumerate(texts):
                    if text and _SEED.search(text):
                        base = base_spans(text)
                        texts[i] = mask(text, base + field.value.added(text, base))
                columns = {name: batch.column(name) for name in batch.schema.names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    old, kept = columns["n_chars"], batch.column("text").to_pylist()
                    n = [len(t) if t is not None and t != k else o for t, k, o in zip(texts, kept, old.to_pylist(), strict=True)]
                    columns["n_chars"] = pa.array(n, old.type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
