"""Fill-in-middle against plain string code, and on awkward input."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sondage.llm import fim

from .conftest import CLASHES

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": None, "char": r"(?s)."}


def split(text, unit):
    if unit == "word":  # a unit begins where white space ends
        at = [0, *(m.end() - 1 for m in re.finditer(r"[\t-\r ][^\t-\r ]", text)), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])] if text else []
    return re.findall(UNITS[unit], text)


def expected(doc_id, text, unit, rate, spm_rate):
    text, units = text or "", split(text or "", unit)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("rate,spm_rate,piece", [(100, 50, 4_000_000), (60, 0, 40), (90, 100, 1)])
def test_against_strings(spark, unit, rate, spm_rate, piece):
    r = random.Random(12)
    texts = [None, "", "\n", "\n\n", "a", "a<", "P>b", "<P>", "x<S>y", "<M", ">", "é\r\n日本\n\n語🙂", "x\x00\ny"]
    texts += ["".join(r.choice(["a", " ", "\n", "é", "日", "🙂", "<", "P>", "\t", "\r"]) for _ in range(r.randint(0, 40))) for _ in range(150)] + ["line of text\n" * 3000]
    rows = [*enumerate(texts), (None, "no id\nat all\n"), (5, "again\nfive\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.restore(fim.fill_in_middle(df, unit=unit, rate=rate, spm_rate=spm_rate, piece_bytes=piece), piece_bytes=piece).collect()
    mine = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr)
    assert mine == sorted(((i, t, *expected(i, t, unit, rate, spm_rate)) for i, t in rows), key=repr)
    assert all(r.restored == (r.text or "") for r in got)


def test_awkward(awkward, nothing):
    rows = fim.restore(fim.fill_in_middle(awkward), form="form").collect()
    assert len(rows) == 16 and all(r[c] == i for r in rows for i, c in enumerate(CLASHES)) and all(r.restored == (r.text or "") for r in rows)
    assert {r.form for r in rows if not r.text} == {"plain"} and all(r.n_ is not None for r in rows)
    assert fim.restore(fim.fill_in_middle(nothing)).count() == 0


def test_sentinels_and_broken_outputs(spark):
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "d"), ("aa", "b", "c"), ("xyx", "b", "c"), ("b", "abc", "d")):
        with pytest.raises(ValueError):
            fim.checked(bad)
    df = spark.createDataFrame([(1, "one\ntwo\nthree\n")], "doc_id long, text string")
    own = ("[[pre]]", "{{suf}}", "((mid))")
    back = fim.restore(fim.fill_in_middle(df, sentinels=own), sentinels=own).first()
    assert back.restored == back.text and back.output != back.text
    with pytest.raises(Exception, match="not of its form"):
        fim.restore(spark.createDataFrame([("<P>a<M>b", "psm")], "output string, form string")).collect()
    assert fim.restore(spark.createDataFrame([(None, "psm")], "output string, form string").where(F.lit(False))).count() == 0
