"""Removal of repeated passages of words against counting every window."""

import collections
import random
import re

import pytest

from sondage.llm import anchors, suffix

from .conftest import prose


def brute(texts, n):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count, out = collections.Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1)), []
    for w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((len(w), " ".join(x for x, g in zip(w, gone) if not g), [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 13, 14, 35, 61])
def test_against_brute_force(spark, window, monkeypatch):
    # Many small blocks: one for each part of the input.
    monkeypatch.setattr(anchors, "packed_texts", lambda docs: suffix.packed_texts(docs.repartition(24, "doc_id")))
    r = random.Random(window)
    blank = lambda: r.choice([" ", "  ", "\n", "\t \r\n", "\x0b", "\x0c"])
    text = lambda words, n: blank().join(r.choice(words) + blank() for _ in range(n))
    texts = [None, "", " \n ", "a", " ", "a b c"] + [text("ab", r.randint(0, 90)) for _ in range(40)] + [text(["x", "é", "日本", "X"], r.randint(0, 200)) for _ in range(20)]
    passage = prose(5, 80)
    texts += [f"{prose(i, 50)} {passage} {prose(100 + i, 30)}" for i in range(5)] + [" ".join(["tick"] * 150), "tock " * 70, prose(1, 60), prose(1, 60), prose(2, window), prose(2, window)[:-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.kept, [(s["first"], s["last"]) for s in x.spans]) for x in anchors.repeated_words(df, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_awkward(awkward, nothing):
    rows = collections.defaultdict(list)
    for r in anchors.repeated_words(awkward).collect():
        rows[r.doc_id].append((r.n_words, r.kept))
    assert rows[1] == rows[2] == [(120, "")] and rows[3] == rows[4] == rows[5] == [(0, "")] and rows[8] == [(1, "the")] * 2 and rows[6] == [(30_000, "")] and rows[11] == [(301, "tail")] and len(rows[None]) == 2
    assert anchors.repeated_words(nothing).count() == 0
