"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import mix, packed, prepare, remainder, unpacked

DIM = 1024
GRAM = 3
UNKNOWN = "und"
#: Code points and texts of a step, trigrams whose vectors are held at once, and cells of a count matrix.
STEP, ROWS, GRAMS, CELLS = 500_000, 2_000, 8_192, 2_000_000


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A random vector of -1 and 1 for each code point, the same on every machine; 0 stands for a word's edge."""
    seeds = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    bits = np.unpackbits(mix(seeds).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(vectors: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Each trigram's vector: its letters' vectors, each rotated by its distance to the last, multiplied."""
    out = np.ones((len(grams), DIM), np.int8)
    for k in range(GRAM):
        out *= np.roll(vectors, GRAM - 1 - k, axis=1)[grams[:, k]]
    return out.astype(np.float32)


def _steps(texts: list):
    """Runs of (number of the text, a piece of it in lower case, bounds of the letters to count): at most ROWS pieces and STEP
    code points. A piece of a longer text has one more code point on either side where the text goes on."""
    held, total = [], 0
    for i, t in enumerate(texts):
        t = t.lower() if isinstance(t, str) else ""
        for a in range(0, max(len(t), 1), STEP):
            b = min(a + STEP, len(t))
            if held and (total + b - a > STEP or len(held) == ROWS):
                yield held
                held, total = [], 0
            first = max(a - 1, 0)
            held.append((i, t[first : b + 1], a - first, b - first))
            total += b - a
    if held:
        yield held


def trigrams(pieces: list[tuple[str, int, int]]):
    """For (text in lower case, bounds of the letters to count): the piece and trigram number of each trigram, the letters of
    each trigram, the vectors of the letters, and which pieces have letters.

    Letters follow str.isalpha; everything else ends a word, and a word's edge
    counts as one symbol. Trigrams lie within one word and its edges; one counts
    where its middle letter does.
    """
    size = np.fromiter((len(t) for t, _, _ in pieces), np.int64, len(pieces)) + 1
    codes = np.frombuffer(("\0" + "\0".join(t for t, _, _ in pieces) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where(letters()[codes], codes, 0)
    start = np.concatenate(([0], np.cumsum(size)))[:-1] + 1
    mid = np.flatnonzero(symbols)
    piece = np.searchsorted(start, mid, side="right") - 1
    at = mid - start[piece]
    low, high = (np.array([p[k] for p in pieces], np.int64) for k in (1, 2))
    counts = (at >= low[piece]) & (at < high[piece])
    mid, piece = mid[counts], piece[counts]
    lettered = np.bincount(piece, minlength=len(pieces)) > 0
    alphabet, ids = np.unique(symbols, return_inverse=True)
    n = len(alphabet)
    gram = (ids[mid - 1] * n + ids[mid]) * n + ids[mid + 1]
    if n**GRAM <= 4_000_000:
        present = np.flatnonzero(np.bincount(gram, minlength=1))
        number = np.zeros(n**GRAM, np.int64)
        number[present] = np.arange(len(present))
        gram = number[gram]
    else:
        present, gram = np.unique(gram, return_inverse=True)
    return piece, gram, np.column_stack([present // n**2, present // n % n, present % n]), letter_vectors(alphabet), lettered


def bundle(groups: np.ndarray, gram: np.ndarray, parts: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """For each of n groups in ascending order, the sum of its trigrams' vectors; GRAMS of these are made at once."""
    out = np.zeros((n, DIM), np.float32)
    order = np.argsort(gram, kind="stable") if len(parts) > GRAMS else None
    for first in range(0, len(parts), GRAMS):
        last = min(first + GRAMS, len(parts))
        of, number = groups, gram
        if order is not None:
            some = np.sort(order[slice(*np.searchsorted(gram[order], [first, last]))])
            of, number = groups[some], gram[some] - first
        made, width = gram_vectors(vectors, parts[first:last]), last - first
        step = max(1, CELLS // width)
        for a in range(0, n, step):
            b = min(a + step, n)
            lo, hi = np.searchsorted(of, [a, b])
            if hi > lo:
                counts = np.bincount((of[lo:hi] - a) * width + number[lo:hi], minlength=(b - a) * width).reshape(b - a, width)
                out[a:b] += counts.astype(np.float32) @ made
    return out


def bundled(texts: list):
    """(numbers of texts, their vectors, which have letters): a bounded number of texts at once, each of them whole."""
    held = None
    for step in _steps(texts):
        of, row = np.unique([i for i, *_ in step], return_inverse=True)
        piece, gram, parts, vectors, some = trigrams([p[1:] for p in step])
        sums = bundle(row[piece], gram, parts, vectors, len(of))
        lettered = np.bincount(row, some, len(of)) > 0
        if held is not None:
            if held[0][0] == of[0]:
                sums[0] += held[1][0]
                lettered[0] |= held[2][0]
            else:
                yield held
        # The last text may go on in the next step.
        yield of[:-1], sums[:-1], lettered[:-1]
        held = of[-1:], sums[-1:], lettered[-1:]
    if held is not None:
        yield held


def _profile(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for part in parts:
        langs = np.array(part["lang"].tolist(), dtype=object).astype(str)
        for step in _steps(part["text"].tolist()):
            names, group = np.unique(langs[[i for i, *_ in step]], return_inverse=True)
            piece, gram, letters_of, vectors, _ = trigrams([p[1:] for p in step])
            by = np.argsort(group[piece], kind="stable")
            for name, v in zip(names.tolist(), bundle(group[piece][by], gram[by], letters_of, vectors, len(names)).astype(np.float64)):
                sums[name] = sums.get(name, 0.0) + v
    yield pd.DataFrame([(k, i, float(x)) for k, v in sums.items() for i, x in enumerate(v)], columns=["lang", "i", "x"]).astype({"i": "int32", "x": "float64"})


def prototypes(docs: DataFrame, folds: int = 4, fold: int = 2) -> tuple[list[str], np.ndarray]:
    """The languages and their bundled vectors, from all documents outside the held-out fold.

    Each task adds up one vector a language; the sums of DIM numbers for each
    lang value are what reaches the driver.
    """
    teach = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", folds) != fold)).select("lang", "text")
    rows = teach.mapInPandas(_profile, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = r["x"]
    names = sorted(k for k, v in found.items() if np.any(v))
    unit = [found[k] / np.linalg.norm(found[k]) for k in names]
    return names, np.array(unit, np.float32).reshape(-1, DIM)


def predict_udf(names: list[str], unit: np.ndarray):
    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for of, vectors, lettered in bundled(texts.tolist()):
                norm = np.linalg.norm(vectors, axis=1)
                use = np.flatnonzero(lettered & (norm > 0)) if names else np.zeros(0, np.int64)
                if len(use):
                    cosine = (vectors[use] @ unit.T) / norm[use, None]
                    best = cosine.argmax(1)
                    pred[of[use]] = np.array(names, object)[best]
                    score[of[use]] = np.clip(cosine[np.arange(len(use)), best].astype(float), 0, 1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return predict


def identify(docs: DataFrame, *, folds: int = 4, fold: int = 2) -> DataFrame:
    """docs with held_out, lang_pred and score (the cosine with the nearest prototype, 0 to 1).

    All columns of docs stay (a result whose name is taken gets an underscore
    behind it); the prediction uses the whole text alone. Texts
    that are null or have no letter are `und` with score 0, as is everything
    when no document teaches. A null lang teaches nothing; a null doc_id is
    held out. Equal cosines go to the first language by name. A text of any
    length is read in pieces, whose sums are those of the whole.
    """
    prepare(docs.sparkSession)
    names, unit = prototypes(docs, folds, fold)
    out = packed(docs, id=F.col("doc_id"), text=F.col("text")).withColumn("found", predict_udf(names, unit)("text"))
    held_out = F.coalesce(remainder("id", folds) == fold, F.lit(True))
    return unpacked(out, docs, held_out=held_out, lang_pred=F.col("found.lang_pred"), score=F.col("found.score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
