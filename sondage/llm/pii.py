"""Personal data found by a semi-Markov conditional random field over candidate spans."""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from math import exp

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import packed, prepare, replaced, unpacked

KINDS = ("email", "ip", "card", "phone")

# Base patterns; written so that each reads a text once, however long its runs are.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            yield first, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches that hold, by kind and start."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


# The field ----------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
#: Words that announce a kind, fixed.
CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telephone", "ring"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "email": ("email", "mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "ping"),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
#: Bounds of an entity: tokens, and characters.
MOST_TOKENS, MOST_CHARS = 16, 80
#: Tokens before an entity that its features look at, and tokens whose candidates are made at once.
CONTEXT, TOKENS_AT_ONCE = 2, 4_000
_JOINTS = frozenset("+-.() /")


class Known:
    """Base spans, with an answer in logarithmic time to whether one of them overlaps another span."""

    def __init__(self, spans):
        self.spans = frozenset(spans)
        places = sorted((s, e) for _, s, e in self.spans)
        self.starts = [s for s, _ in places]
        self.ends = list(accumulate((e for _, e in places), max))

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def number(word: str) -> bool:
    return word.isascii() and word.isdigit()


def candidates(text: str, toks: list[tuple[int, int]], low: int = 0, high: int | None = None) -> list[tuple[int, int, str]]:
    """(first token, token after the last, family) of spans that could be an entity and begin in [low, high): numbers, or words with an at sign."""
    out, n = [], len(toks)
    words = [text[s:e] for s, e in toks]
    for i in range(low, n if high is None else high):
        w = words[i]
        if number(w) or w in "+(":
            for j in range(i, min(n, i + MOST_TOKENS)):
                if j > i and (toks[j][0] - toks[j - 1][1] > 1 or text[toks[j - 1][1] : toks[j][0]] == "\n"):
                    break
                if not (number(words[j]) or words[j] in _JOINTS) or toks[j][1] - toks[i][0] > MOST_CHARS:
                    break
                if number(words[j]) and not (j + 1 < n and toks[j + 1][0] == toks[j][1] and words[j + 1][0].isalnum()):
                    out.append((i, j + 1, "number"))
        if w[0].isalnum():
            sign = None
            for j in range(i, min(n, i + MOST_TOKENS)):
                if toks[j][1] - toks[i][0] > MOST_CHARS or (j > i and "\n" in text[toks[j - 1][1] : toks[j][0]]):
                    break
                if j > i and (words[j] == "@" or words[j].lower() == "at"):
                    sign = sign or j
                elif sign is None and j > i and (toks[j][0] > toks[j - 1][1] and words[j][0] not in "[(" and words[j - 1][-1] not in "[("):
                    break
                elif sign is not None and j > sign and words[j][0].isalpha() and words[j].isascii():
                    out.append((i, j + 1, "words"))
    return out


def features(text: str, toks, i: int, j: int, family: str, base: Known) -> list[str]:
    """What a whole span and its surroundings show, the same for every kind."""
    s, e = toks[i][0], toks[j - 1][1]
    span = text[s:e]
    out = ["bias", family]
    same = [f"base:{k}" for k in KINDS if (k, s, e) in base.spans]
    out += same or (["overlaps"] if base.overlaps(s, e) else [])
    before = text[toks[i - 1][0] : toks[i - 1][1]] if i else ""
    cue = _CUE_OF.get(before.lower()) or (_CUE_OF.get(text[toks[i - 2][0] : toks[i - 2][1]].lower()) if i > 1 and before in (":", "is", "at", "me") else None)
    out += [f"cue:{cue}"] if cue else []
    out += ["tight_before"] if s and text[s - 1] in "+-./:@$(" and not text[s - 1].isspace() else []
    out += ["tight_after"] if e < len(text) and text[e] in "+-/@%:" or text[e : e + 1] in (".", ",") and text[e + 1 : e + 2].isdigit() else []
    if family == "number":
        d = _digits(span)
        out += [f"digits:{min(len(d), 20)}", "luhn" if len(d) >= 13 and luhn(d) else "plain"]
        shape = re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 20)), span)
        out.append(f"shape:{shape}")
        out += ["plus"] if span[0] == "+" else []
        joints = set(span) - set("0123456789")
        out.append("joints:" + "".join(sorted(joints)))
        parts = span.split(".")
        out.append("quad" if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else "no_quad")
    else:
        low = span.lower()
        sign = "@" if "@" in low else "[at]" if "[at]" in low or "(at)" in low or "[ at ]" in low else "at"
        dot = "." if re.search(r"[a-z0-9]\.[a-z]", low.split(sign)[-1]) else "[dot]" if "[dot]" in low or "(dot)" in low else "dot" if re.search(r"\bdot\b", low) else "none"
        out += [f"sign:{sign}:{dot}"]
        words = re.findall(r"[a-z0-9]+", low)
        out += [f"last:{words[-1]}" if words[-1] in ("com", "org", "net", "edu", "de", "fr", "es", "io") else "last:other", f"words:{min(len(words), 9)}"]
        tail = words[words.index("at") + 1 :] if "at" in words else words
        out += ["spelled"] if dot == "dot" and len(tail) >= 3 and tail[-2] == "dot" else []
        out += ["again"] if low.count("@") + words.count("at") > 1 else []
    return out


class Field:
    """Weights of (feature, kind), and of an entity right after another; a token outside has score 0."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = defaultdict(float)

    def segments(self, text: str, toks, base: Known, low: int = 0, high: int | None = None):
        """By end token: (start token, kind, features) of the candidates that begin in [low, high)."""
        by: dict[int, list[tuple[int, str, list[str]]]] = defaultdict(list)
        for i, j, family in candidates(text, toks, low, high):
            fs = features(text, toks, i, j, family, base)
            for kind in KINDS if family == "number" else ("email",):
                by[j].append((i, kind, fs))
        return by

    def score(self, kind: str, fs: list[str]) -> float:
        get = self.weights.get
        return sum(get((f, kind), 0.0) for f in fs)

    def best(self, text: str, start: int, end: int, base: Known) -> list[tuple[str, int, int]]:
        """The segmentation of text[start:end] with the highest score: of each prefix, one that ends outside (0) and one that
        ends in an entity (1).

        Candidates are made for some thousand tokens at a time, which changes
        nothing, since they are bounded; what stays are numbers by token.
        """
        first, last = array("q"), array("q")
        for m in _TOKEN.finditer(text, start, end):
            first.append(m.start())
            last.append(m.end())
        n, low = len(first), float("-inf")
        after = self.weights.get(("after", ""), 0.0)
        value = array("d", [0.0, low]) + array("d", [low, low]) * n
        # Of each prefix: how the one outside went on (0 or 1); where the entity of the other begins, its kind and what came before.
        outside, begin, kinds, came = array("b", [0]) * (n + 1), array("q", [0]) * (n + 1), array("b", [0]) * (n + 1), array("b", [0]) * (n + 1)
        pending: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for a in range(0, n, TOKENS_AT_ONCE):
            b, back = min(a + TOKENS_AT_ONCE, n), min(a, CONTEXT)
            some = [(first[k], last[k]) for k in range(a - back, min(b + MOST_TOKENS + 1, n))]
            for j, rows in self.segments(text, some, base, back, back + b - a).items():
                for i, kind, fs in rows:
                    pending[j + a - back].append((i + a - back, KINDS.index(kind), self.score(kind, fs)))
            for j in range(a + 1, b + 1):
                was = 0 if value[2 * j - 2] >= value[2 * j - 1] else 1
                value[2 * j], outside[j] = value[2 * j - 2 + was], was
                for i, kind, own in pending.pop(j, ()):
                    for was, more in ((0, 0.0), (1, after)):
                        if (total := value[2 * i + was] + own + more) > value[2 * j + 1]:
                            value[2 * j + 1], begin[j], kinds[j], came[j] = total, i, kind, was
        out, j, was = [], n, 0 if value[2 * n] >= value[2 * n + 1] else 1
        while j:
            if was:
                out.append((KINDS[kinds[j]], first[begin[j]], last[j - 1]))
                j, was = begin[j], came[j]
            else:
                j, was = j - 1, outside[j]
        return out[::-1]

    def fit(self, sentences: list[tuple[str, list[tuple[str, int, int]]]], *, epochs: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> Field:
        """Gradient ascent on the conditional likelihood; expectations by the forward and backward sums."""
        ready = []
        for text, gold in sentences:
            toks = tokens(text, 0, len(text))
            begin, end = {s: i for i, (s, _) in enumerate(toks)}, {e: i + 1 for i, (_, e) in enumerate(toks)}
            wanted = {(begin[s], end[e], k) for k, s, e in gold if s in begin and e in end}
            ready.append((len(toks), self.segments(text, toks, Known(base_spans(text))), wanted))
        square: dict[tuple[str, str], float] = defaultdict(lambda: 1e-6)
        for _ in range(epochs):
            for n, by, wanted in ready:
                gradient: dict[tuple[str, str], float] = defaultdict(float)
                scored = [(i, j, k, fs, self.score(k, fs)) for j, rows in by.items() for i, k, fs in rows]
                ends, starts = defaultdict(list), defaultdict(list)
                for row in scored:
                    ends[row[1]].append(row)
                    starts[row[0]].append(row)
                after = self.weights[("after", "")]
                # Sums over segmentations of a prefix that end outside or in an entity, and of a suffix given what came before.
                left = [(1.0, 0.0)]
                for j in range(1, n + 1):
                    out = left[j - 1][0] + left[j - 1][1]
                    inside = sum(exp(s) * (left[i][0] + left[i][1] * exp(after)) for i, _, _, _, s in ends[j])
                    left.append((out, inside))
                right = [(1.0, 1.0)] * (n + 1)
                for i in range(n - 1, -1, -1):
                    inside = sum(exp(s) * right[j][1] for _, j, _, _, s in starts[i])
                    right[i] = (right[i + 1][0] + inside, right[i + 1][0] + inside * exp(after))
                total = sum(left[n])
                for i, j, k, fs, s in scored:
                    alone = left[i][0] * exp(s) * right[j][1] / total
                    next_to = left[i][1] * exp(s + after) * right[j][1] / total
                    change = ((i, j, k) in wanted) - alone - next_to
                    for f in fs:
                        gradient[f, k] += change
                    gradient["after", ""] -= next_to
                gradient["after", ""] += sum(any(i == e for _, e, _ in wanted) for i, _, _ in wanted)
                for key, g in gradient.items():
                    g -= ridge * self.weights[key]
                    square[key] += g * g
                    self.weights[key] += rate * g / square[key] ** 0.5
        return self


def sentences(n: int = 700, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented sentences with marked personal data, and with numbers and phrases that only look like it."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "io"])

    def check(prefix: str, size: int) -> str:
        body = prefix + d(size - 1 - len(prefix))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def split(s: str, cuts: tuple[int, ...], sep: str) -> str:
        out, at = [], 0
        for c in cuts:
            out.append(s[at : at + c])
            at += c
        return sep.join(out)

    def wrong(size: int) -> str:
        while luhn(s := r.choice("345") + d(size - 1)):
            pass
        return s

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            a, b = w(), w()
            return kind, r.choice([f"{a}.{d(2)}@{b}.{tld()}", f"{a}@{w()}.{b}.{tld()}", f"{a} at {b} dot {tld()}", f"{a} [at] {b} [dot] {tld()}", f"{a}(at){b}.{tld()}", f"{a} (at) {b} (dot) {tld()}"])
        if kind == "ip":
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            s, sep = check(r.choice("45"), 16), r.choice(["", "", " ", "-"])
            return kind, r.choice([split(s, (4, 4, 4, 4), sep), split(check("37", 15), (4, 6, 5), sep)])
        sep = r.choice("-. ")
        return kind, r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{'-.'[sep == '.']}{d(3)}{'-.'[sep == '.']}{d(4)}", f"+{d(11)}", f"({d(3)}) {d(3)} {d(4)}"])

    def other() -> str:
        return r.choice([
            f"20{d(2)}-0{d(1)}-1{d(1)}", f"0{d(1)}/1{d(1)}/20{d(2)}", f"1{d(1)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(2)}.{d(2)}.{d(2)}.9{d(2)}", f"{d(1)},{d(3)}.{d(2)}",
            d(8), d(14), d(r.randint(1, 7)), wrong(16), wrong(16), split(wrong(16), (4, 4, 4, 4), "-"), f"{d(2)}-{d(2)}", f"{d(3)}-{d(1)}-{d(5)}-{d(1)}", d(10), d(13), d(24), f"{w()} at {w()}", f"{w()} at the {w()} {w()}",
            f"{w()} dot {w()}", f"at {w()} dot", f"{d(2)} at {w()}", f"{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(5)} {d(6)}", f"{d(3)}.{d(2)}", f"{w()} at {w()} dot {w()} {w()}",
        ])

    out = []
    for _ in range(n):
        text, gold = w(), []
        for _ in range(r.randint(1, 4)):
            text += r.choice([" ", " ", ", ", ". "]) + " ".join(w() for _ in range(r.randint(1, 4)))
            if r.random() < 0.5:
                kind, span = entity()
                text += f" {r.choice(CUES[kind])}{r.choice([':', '', ' is'])}" if r.random() < 0.4 else ""
                text += " "
                gold.append((kind, len(text), len(text) + len(span)))
                text += span
            else:
                text += " " + other()
        out.append((text + r.choice([".", "", " " + w()]), gold))
    return out


@cache
def trained() -> Field:
    """The field fitted on the invented sentences, the same every time."""
    field = Field().fit(sentences())
    field.weights = dict(field.weights)
    return field


#: What every candidate holds: a digit, an at sign, or the word at.
_ANCHOR = re.compile(r"[0-9]+|@|(?<![^\W\d_])at(?![^\W\d_])", re.IGNORECASE)
#: Characters around an anchor that a candidate can take, and some more.
ROOM = MOST_CHARS + 20


def anchored(text: str):
    """Runs of anchors of which no two neighbours have more than 2 * ROOM between them."""
    first = last = -1
    for m in _ANCHOR.finditer(text):
        if first >= 0 and m.start() - last > 2 * ROOM:
            yield first, last
            first = -1
        first, last = (m.start() if first < 0 else first), m.end()
    if first >= 0:
        yield first, last


def widened(text: str, first: int, last: int) -> tuple[int, int]:
    """A run of anchors with the room that a candidate can take and the CONTEXT words before it. A word is cut only where more
    of it stays than a candidate or a cue can have, so that nothing in the stretch depends on where it was cut."""
    start, end = max(0, first - ROOM), min(len(text), last + ROOM)
    for _ in range(CONTEXT + 1):
        while start > 0 and text[start - 1].isspace():
            start -= 1
        most = max(0, start - 2 * ROOM)
        while start > most and not text[start - 1].isspace():
            start -= 1
    most = min(len(text), end + ROOM)
    while end < most and not text[end].isspace():
        end += 1
    return start, end


def regions(text: str):
    """Stretches, apart from each other, that hold every candidate of the text with its context."""
    held = None
    for start, end in (widened(text, *a) for a in anchored(text)):
        if held and start > held[1]:
            yield held
            held = None
        held = (held[0] if held else start, end)
    if held:
        yield held


def find(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind and start: all base spans, and those that the field adds beside them."""
    base = base_spans(text)
    known = Known(base)
    spans = {(k, s, e): True for k, s, e in base}
    for start, end in regions(text):
        for kind, s, e in field.best(text, start, end, known):
            if not known.overlaps(s, e):
                spans.setdefault((kind, s, e), False)
    return sorted(((k, s, e, b) for (k, s, e), b in spans.items()), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


SPANS = "array<struct<kind:string,first:long,last:long,base:boolean>>"


def find_udf(field):
    @F.pandas_udf(SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [find(t, field.value) if isinstance(t, str) else [] for t in texts]
            yield pd.Series([[{"kind": k, "first": s, "last": e, "base": b} for k, s, e, b in rows] for rows in found])

    return spans


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with `pii`: the spans of personal data in each whole text, by kind and start, in code points.

    The spans that match a base pattern are all there, with base = true; the
    field, which reads all stretches where one of its candidates can be (around
    digits, at signs and the word at), each of them whole however long it is, adds others (numbers and addresses written in other
    ways) where no base span lies. All columns of docs stay (if one is called
    pii, the result is `pii_`). Null and empty texts have none;
    repeated rows have the same. The field is trained on invented sentences on
    the driver; its weights are all that is sent.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    return unpacked(packed(docs, text=F.col("text")).withColumn("found", find_udf(sent)("text")), docs, pii=F.col("found"))


def without(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Text with each stretch that spans cover replaced by the kind of its first span."""
    parts, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with each stretch of personal data replaced by its kind in angle brackets; rules as in find_pii(). Only text changes."""
    prepare(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(trained())

    # Finding and replacing in one function: a task needs one Python worker.
    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([without(t, find(t, field.value)) if isinstance(t, str) else None for t in texts], dtype=object)

    return replaced(packed(docs, text=F.col("text")).withColumn("new", rewrite("text")), docs, "text", F.col("new"))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("pii")).alias("spans"))
