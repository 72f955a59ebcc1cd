"""Corpus operators against brute force, and on awkward input."""

import base64
import collections
import functools
import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.llm import common, decontam, embed, langid, minhash, mixing, pii, quality, suffix, tokens, warc
from sondage.llm.registry import QUERIES, SQL
from sondage.operators.graph import components

from sondage.sources.files import scratch

from .conftest import CLASHES, prose


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, agree):
    agree(QUERIES[name], SQL[name])


def own_columns_stay(rows):
    return all(r[c] == i for r in rows for i, c in enumerate(CLASHES))


# 1 -----------------------------------------------------------------------------------


def expected_pages(rows):
    out = []
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        top = max(ids) if ids else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


def test_warc_round_trip(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n0\r\n" * 4000
    rows = [(1, "u1", "x"), (2, "u2", big), (3, None, big), (4, "u\r\n4", None), (5, "u5", ""), (6, "u6", "x"), (None, "n", "x"), (7, "u7", "y" * 8000), (8, "u8", "y" * 8000 + "z"), (9, "r", big + "."), (9, "r", big + ".")]
    path = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment_bytes=500, chunk_bytes=64, pack_bytes=3000, packs_per_file=2)
    got = warc.read_warc(spark, path).withColumn("page", warc.page_id("record_id")).withColumn("to", warc.page_id("refers_to")).collect()
    assert not [r.error for r in got if r.error]
    assert sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.to) for r in got), key=repr) == expected_pages(rows)
    assert all(bytes(r.payload).decode() in (dict((i, h or "") for i, _, h in rows)[r.page],) for r in got if r.record_type == "response")


def test_warc_empty(spark):
    path = scratch(spark, "none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_reports_broken_records(spark, tmp_path):
    block = warc.STATUS + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world" * 50, 16)
    good = list(warc.segments("urn:page:1:a", "d", block, {}, 100))
    lost = list(warc.segments("urn:page:2:a", "d", block, {}, 100))
    short = list(warc.segments("urn:page:3:a", "d", block, {}, 100))
    wrong = warc.record("response", "urn:page:4:a", "d", block, {"WARC-Payload-Digest": "sha1:AAAA"})
    data = [*good[::-1], lost[0], *lost[2:], *short[:-1], wrong]
    (tmp_path / "x.warc").write_bytes(b"".join(r + warc.END for r in data))
    rows = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert bytes(rows["urn:page:1:a"].payload) == b"hello world" * 50 and rows["urn:page:1:a"].error is None
    assert "segments" in rows["urn:page:2:a"].error and "bytes" in rows["urn:page:3:a"].error and "digest" in rows["urn:page:4:a"].error
    assert rows["urn:page:2:a"].payload is None


def test_chunk_framing():
    r = random.Random(1)
    for n in (0, 1, 15, 16, 17, 1000):
        b = r.randbytes(n)
        assert warc.unchunked(warc.chunked(b, 16)) == b
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.unchunked(bad)


# 2 -----------------------------------------------------------------------------------


def test_token_counts_are_the_tokenizers():
    from tokenizers import Tokenizer, models

    v = tokens.load(tokens.QUERY_MODEL)
    c = tokens.Counter(v)
    theirs = Tokenizer(models.Unigram([("<unk>", 0.0), *v.scores.items(), *[(f"<0x{i:02X}>", 0.0) for i in range(256)]], unk_id=0, byte_fallback=True))
    r = random.Random(2)
    texts = ["".join(r.choice("ab  \n\tñ日本🙂thes▁\x00") for _ in range(r.randint(0, 80))) for _ in range(1500)] + [prose(s, 60) for s in range(50)]
    for t in texts:
        want = len(theirs.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert c.text(t)[1] == want, t


def test_batches_of_texts_count_like_single_ones(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "SHORT", 12)
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    r = random.Random(37)
    texts = ["", "\n", " ", "▁", "a\n\n b"] + ["".join(r.choice("ab  \n\tñ日本🙂thes▁\x00") for _ in range(r.randint(0, 60))) for _ in range(400)] + [prose(s, 30) for s in range(20)]
    for vocabulary in (tokens.load(tokens.QUERY_MODEL), tokens.Vocabulary({"a": -1.0, "▁a": -1.5, "b": -1.0, "▁": -3.0, "ab": -2.0}, -3.0, False, True), tokens.Vocabulary({"a\nb": -1.0, "a": -2.0}, -2.0, True, False)):
        c, alone = tokens.Counter(vocabulary), tokens.Counter(vocabulary)
        for a in range(0, len(texts), 90):
            some = texts[a : a + 90]
            n, score = c.batch([t.encode() for t in some])
            want = [alone.text(t) for t in some]
            assert n.tolist() == [k for _, k in want] and score.tolist() == pytest.approx([s for s, _ in want])


def test_token_search_against_all_segmentations():
    r = random.Random(3)
    for _ in range(200):
        pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 3))): float(-r.randint(1, 4)) for _ in range(8)}
        c = tokens.Counter(tokens.Vocabulary(pieces, min(pieces.values()), False, False))
        text = "".join(r.choice("abcd ") for _ in range(9))
        marked, best = text.replace(" ", "▁"), {0: (0.0, 0)}
        for s in range(len(marked)):
            found = [(s + len(p), v) for p, v in pieces.items() if marked.startswith(p, s)]
            found += [] if marked[s] in pieces else [(s + 1, c.unknown)]
            for e, v in sorted(found):
                if e not in best or best[s][0] + v > best[e][0]:
                    best[e] = (best[s][0] + v, best[s][1] + 1)
        assert c.text(text) == best[len(marked)] == c.search_many([marked])[0]


def test_token_counts_awkward(awkward, nothing):
    v = tokens.load(tokens.QUERY_MODEL)
    rows = tokens.count_tokens(awkward, v).collect()
    assert len(rows) == 16 and all((r.n_tokens_ == 0) == (not r.text) for r in rows) and own_columns_stay(rows)
    assert all((r.score_ == 0) == (not r.text) for r in rows)
    assert tokens.count_tokens(nothing, v).count() == 0


# 3 -----------------------------------------------------------------------------------


def shingle_counts(text):
    w = text.encode().lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_similarity(x, y):
    common_, every = set(x) & set(y), set(x) | set(y)
    if not common_:
        return 0.0
    u, v = ({k: 1 + math.log(n) for k, n in c.items()} for c in (x, y))
    return max(len(common_) / len(every), sum(1 / sum(max(u.get(j, 0) / u[d], v.get(j, 0) / v[d]) for j in every) for d in common_))


def brute_classes(rows):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    counts = [shingle_counts(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if top(i) != top(j) and (rows[i][1] == rows[j][1] or brute_similarity(counts[i], counts[j]) >= 0.8):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(rows)}


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randint(0, 999)}" if r.random() < share else w for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    base = [prose(s, 80) for s in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + k, edited(base[k % 12], k, random.Random(k).choice([0.005, 0.02, 0.04, 0.1]))) for k in range(120)]
    # A group around one original, whose copies are nearer to it than to each other; and one repeated line.
    rows += [(300 + k, edited(prose(99, 100), 500 + k, 0.02)) for k in range(60)] + [(400, prose(99, 100))]
    rows += [(500 + k, "same line here again now " * 200 + prose(700 + k, 30)) for k in range(6)] + [(600, base[0]), (601, base[0].upper()), (602, "one two"), (603, "One  TWO"), (604, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert found == brute_classes(rows)


def test_near_duplicates_whose_lines_repeat_differently(spark):
    # Copies have the same shingles but for a few, and one has a line far more often: plain Jaccard over 0.8, of the weights far under.
    rows = []
    for k in range(40):
        lines, own = prose(5000 + k, 60).split(), [f"l{k}x{i}" for i in range(22)]
        rows += [(2 * k, " ".join(lines + own * 300)), (2 * k + 1, " ".join(lines + own + own[:4] + [f"t{i}" for i in range(14)]))]
    # A larger group, whose members repeat a line 1 to 181 times.
    rows += [(1000 + k, " ".join(prose(77, 60).split() + [f"m{i}" for i in range(20)] * (1 + 60 * (k % 4)) + [f"e{k}"])) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = brute_classes(rows)
    assert all(wanted[2 * k + 1] == 2 * k for k in range(40))
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == wanted


def test_one_of_several_texts_with_the_smallest_id_is_kept(spark):
    text = prose(31, 100)
    df = spark.createDataFrame([(1, text), (1, text + " more"), (1, text + " other"), (2, text + " third"), (3, prose(32, 100))], "doc_id long, text string")
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id for r in rows if r.kept) == [1, 3] == sorted(r.doc_id for r in minhash.keep_one(df).collect())


def test_registers_estimate_both_similarities():
    r = np.random.Generator(np.random.PCG64(5))
    items = r.integers(0, 2**63, 100, dtype=np.uint64)
    a, b = np.sort(items[:95]), np.sort(items[5:])
    x, y = np.where(np.arange(95) < 25, 300, 1), np.ones(90 + 5, int)
    held, filled = minhash.both_sketches(np.repeat([0, 1], 95), np.concatenate((a, b)), np.concatenate((x, y)), 3)
    assert [len(h) for h in held] == [160, 80, 80] and filled.tolist() == [True, True, False]
    weighted, plain = (held[0][:80] == held[1]).mean(), (held[0][80:] == held[1]).mean()
    assert abs(plain - 0.9) < 0.15 and weighted < 0.7


def test_registers_estimate_the_similarity():
    r = np.random.Generator(np.random.PCG64(4))
    agree, real = [], []
    for k in range(60):
        items = r.integers(0, 2**63, 120, dtype=np.uint64)
        a, b = np.sort(items[:100]), np.sort(items[20:])
        x, y = r.integers(1, 5, 100), r.integers(1, 5, 100)
        held, _ = minhash.sketches(np.repeat([0, 1], 100), np.concatenate((a, b)), np.concatenate((minhash.weights(x), minhash.weights(y))), 2)
        agree.append((held[0] == held[1]).mean())
        u, v = dict(zip(a.tolist(), minhash.weights(x))), dict(zip(b.tolist(), minhash.weights(y)))
        real.append(sum(1 / sum(max(u.get(j, 0) / u[d], v.get(j, 0) / v[d]) for j in u.keys() | v.keys()) for d in u.keys() & v.keys()))
    assert abs(np.mean(agree) - np.mean(real)) < 0.02


def test_near_duplicates_awkward(spark, awkward, nothing):
    rows = collections.defaultdict(set)
    for r in minhash.near_duplicates(awkward).collect():
        rows[r.doc_id].add((r.class_id, r.kept))
    assert rows[2] == {(1, False)} and rows[7] == {(6, False)} and rows[11] == {(10, False)} and rows[3] == {(3, True)} and rows[4] == {(4, True)} and rows[5] == {(5, True)} and rows[8] == {(8, True)} and rows[None] == {(None, True)}
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_one(awkward).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 3, 4, 5, None, None, 6, 8, 9, 10, 12, 13])) and own_columns_stay(kept)
    assert minhash.keep_one(nothing).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(60)] + [(500, 500), (None, 3)]
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None and None not in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root


# 4 -----------------------------------------------------------------------------------


def test_targets_by_resharing(spark):
    r = random.Random(6)
    for _ in range(3):
        sizes = {f"s{i}": r.choice([0, 3, 50, 1000, 40000]) for i in range(9)}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3.0, 1.0).collect()}
        weight, fixed, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, {}, set(sizes)
        while True:
            rest, all_ = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in open_)
            over = [s for s in open_ if rest * weight[s] / all_ > 3 * sizes[s]]
            if not over:
                break
            for s in over:
                fixed[s] = 3.0 * sizes[s]
                open_.discard(s)
        want = fixed | {s: rest * weight[s] / all_ for s in open_}
        assert got == pytest.approx(want)


def test_mix_comes_near_its_targets(spark, small):
    rows = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).toPandas()
    again = mixing.mix(spark.read.parquet(f"{small}/documents.parquet").repartition(7)).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    per = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.most).all() and (rows.taken <= 3 * rows["size"]).all()


def test_mix_awkward(spark, awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == 16 and {r.taken for r in rows if not r.size} == {0}
    assert sum(r.size for r in rows if r.source is None) == [r.source_size for r in rows if r.source is None][0]
    out = mixing.mixture(awkward)
    assert out.columns == [*awkward.columns, "copies_"] and out.where("text IS NULL AND copies_ > 3").count() == 0 and own_columns_stay(out.collect())
    assert mixing.mix(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\x0bc\x0c\r\nd ", "x y", "\x1c z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(mixing.word_count("text").alias("n")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# 5 -----------------------------------------------------------------------------------


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        out += [("card", *m.span())] if 16 <= len(d) <= 19 and pii.luhn(d) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_are_the_patterns():
    r = random.Random(7)
    texts = ["".join(r.choice("12 +-.()@ab4\n٣é") for _ in range(r.randint(0, 70))) for _ in range(5000)]
    texts += [a + b for a in ("4111 1111 1111 1111", "+1 (555) 555-1234 ", "1.2.3.4.5.6.7.8", "a@b.c@d.e.f", "a@b@c.d", "0255.1.1.1") for b in ("", "1", "-", "@x.y", ".9", " 2")]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)


def test_field_on_sentences_it_has_not_seen():
    field = pii.trained()
    good = sum({s[:3] for s in pii.find(t, field)} >= set(gold) for t, gold in pii.sentences(200, seed=91))
    assert good >= 190


def test_field_adds_what_patterns_miss():
    field = pii.trained()
    text = "call (555) 123-4567 or ann at mail dot com, cards 4111111111111111 5500005555555559 end 12345678"
    found = {(k, text[s:e]) for k, s, e, _ in pii.find(text, field)}
    assert found == {("phone", "(555) 123-4567"), ("email", "ann at mail dot com"), ("card", "4111111111111111"), ("card", "5500005555555559")}


def test_pii_awkward(awkward, nothing):
    assert own_columns_stay(pii.redact(awkward).collect()) and own_columns_stay(pii.find_pii(awkward).collect())
    assert {r.doc_id: len(r.pii_) for r in pii.find_pii(awkward).collect()}[12] == 4
    rows = {r.doc_id: r for r in pii.redact(awkward).collect()}
    assert rows[12].text == "<EMAIL> <PHONE> <CARD> <IP>" and rows[3].text is None and rows[4].text == "" and rows[9].text == "été à la forêt ñ ß 日本語 🙂"
    assert pii.find_pii(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_pii_reads_long_runs_once():
    import time

    began = time.time()
    pii.find("1" * 100_000 + " " + "a" * 100_000 + "@" + "1 " * 20_000 + "1.1" * 10_000 + "+" + "1" * 100_000, pii.trained())
    assert time.time() - began < 60


# 6 -----------------------------------------------------------------------------------


def brute_links(ids, x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in range(len(ids)):
        new = np.minimum(label, np.where(near, label[None, :], label.max()).min(1))
        if (new == label).all():
            break
        label = new
    return near.sum(1), label


def test_embedding_links_against_brute_force(spark):
    r = np.random.Generator(np.random.PCG64(8))
    centre = r.standard_normal((60, 32))
    x = np.concatenate([centre, centre[r.integers(0, 60, 300)] + 0.12 * r.standard_normal((300, 32)), np.repeat(centre[:2], 1400, 0) + 0.05 * r.standard_normal((2800, 32)), np.repeat(centre[5:6], 40, 0)])
    x = x.astype(np.float32)
    ids = (r.permutation(len(x)) - 500).tolist()
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>").repartition(6)
    got = embed.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    n, label = brute_links(ids, x.astype(float))
    assert (got.n_links.to_numpy() <= n).all() and got.n_links.sum() >= 0.97 * n.sum()
    assert (got.component_id.to_numpy() == label).mean() > 0.99 and (got.kept == (got.component_id == got.index)).all()


def test_embeddings_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [3.0]), (-4, [0.0, 5.0]), (12, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = collections.defaultdict(set)
    for r in embed.near_duplicates(df).collect():
        got[r.vec_id].add((r.n_links, r.component_id, r.kept))
    assert got[1] == {(3, 1, True)} and got[2] == {(3, 1, False)} and got[10] == {(3, 1, False)} and got[9] == {(0, 9, True)} and got[11] == {(0, 11, True)} and got[12] == {(1, -4, False)} and got[None] == {(0, None, False)}
    assert all(got[k] == {(0, k, True)} for k in (3, 4, 5, 6, 7, 8))
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    r = np.random.Generator(np.random.PCG64(9))
    x = r.standard_normal((400, 65))
    x /= np.linalg.norm(x, axis=1)[:, None]
    code, factor, turned, keys = embed.encode(x, 10, 4)
    codes, off = embed.signs_of([c.tobytes() for c in code], 65), ~np.eye(400, dtype=bool)
    packed, low, step = embed.nibbles(turned)
    for query, more in ((turned, 0.0), (embed.widened(packed, low, step, 65), step[None, :])):
        error = (codes @ query.T) / factor[:, None] - x @ x.T
        bound = np.stack([embed.bounds(factor, 65, s) for s in np.broadcast_to(more, (1, 400))[0]], axis=1)
        assert abs(error[off].mean()) < 0.005 and (np.abs(error) <= bound)[off].mean() > 0.999


def test_links_right_over_the_threshold_are_found(spark):
    r = np.random.Generator(np.random.PCG64(35))
    a = r.standard_normal((2500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.standard_normal((2500, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = r.uniform(0.9505, 0.955, 2500)[:, None]
    x = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * side])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(5000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = embed.near_duplicates(df).toPandas().set_index("vec_id")
    assert 0.975 * 5000 <= got.n_links.sum() <= 5000 and (got.component_id <= got.index).all()


def test_linked_vectors_against_sql(spark):
    import duckdb

    r = np.random.Generator(np.random.PCG64(36))
    x = r.standard_normal((60, 16))
    x = np.concatenate([x, x[r.integers(0, 20, 80)] * r.uniform(0.5, 2, 80)[:, None] + 0.03 * r.standard_normal((80, 16)), x[:3], np.zeros((1, 16))])
    rows = pd.DataFrame({"vec_id": [*range(len(x)), 400], "embedding": [*x.tolist(), None]})
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    con = duckdb.connect()
    con.register("embeddings", rows)
    want = con.execute(embed.SQL).df().sort_values("vec_id")
    assert want.n_links.sum() > 200 and got[want.columns].to_numpy().tolist() == want.to_numpy().tolist()


def test_equal_pages_against_sql(spark):
    import duckdb

    rows = pd.DataFrame({"page_id": [5, 3, 9, 1, 2, 8], "url": ["u"] * 6, "html": ["x", "x", "x", None, "", "é" * 9000]})
    path = scratch(spark, "equal")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page: (r.payload_bytes, r.payload_digest, r.record_type, r.to) for r in warc.read_warc(spark, path).withColumn("page", warc.page_id("record_id")).withColumn("to", warc.page_id("refers_to")).collect()}
    con = duckdb.connect()
    con.register("pages", rows)
    assert got == {r[0]: r[1:5] for r in con.execute(warc.SQL).fetchall()}


# 7 -----------------------------------------------------------------------------------


def test_language_on_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = langid.identify(docs).toPandas()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


@pytest.mark.parametrize("step, grams", [(500_000, 8192), (2, 8192), (3, 2)])
def test_language_vectors_are_the_definition(monkeypatch, step, grams):
    text = "Abc été"
    monkeypatch.setattr(langid, "STEP", step)
    monkeypatch.setattr(langid, "GRAMS", grams)
    found = list(langid.bundled([None, text, "", text + " x"]))
    assert [i for of, _, _ in found for i in of] == [0, 1, 2, 3] and [bool(x) for _, _, some in found for x in some] == [False, True, False, True]
    got = np.concatenate([v for _, v, _ in found])[1]
    want = np.zeros(langid.DIM)
    for word in text.lower().split():
        codes = np.array([0, *map(ord, word), 0], np.uint32)
        v = langid.letter_vectors(codes).astype(float)
        for i in range(len(codes) - 2):
            want += np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2]
    assert np.allclose(got, want)


def test_language_awkward(awkward, nothing):
    rows = langid.identify(awkward).collect()
    assert len(rows) == 16 and all(r.lang_pred_ == "und" and r.score_ == 0 for r in rows if not r.text or not any(map(str.isalpha, r.text)))
    assert own_columns_stay(rows) and {r.held_out_ for r in rows if r.doc_id is None} == {True}
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred_ for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 8 -----------------------------------------------------------------------------------


def brute_repeats(texts, n):
    bs = [(t or "").encode() for t in texts]
    count, out = collections.Counter(b[i : i + n] for b in bs for i in range(len(b) - n + 1)), []
    for b in bs:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((bytes(x for x, g in zip(b, gone) if not g), [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]))
    return out


@pytest.mark.parametrize("length", [3, 5, 14, 20, 30, 61])
def test_repeated_strings_against_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 300)
    r = random.Random(10)
    texts = [None, ""] + ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(50)] + ["a" * 50] * 2 + ["é" * 30] + [prose(1, 40), prose(1, 40)[:150] + prose(2, 20), prose(2, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (bytes(x.kept), [(s["first"], s["last"]) for s in x.spans]) for x in suffix.repeated_strings(df, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_difference_covers():
    for limit in (5, 7, 40, 200, 1000):
        v, d = suffix.difference_cover(limit)
        assert v <= max(limit, 1) and len(np.unique((d[:, None] - d) % v)) == v


def test_repeated_strings_awkward(awkward, nothing):
    rows = collections.defaultdict(list)
    for r in suffix.repeated_strings(awkward).collect():
        rows[r.doc_id].append(bytes(r.kept))
    assert rows[1] == rows[2] == [b""] and rows[3] == rows[4] == [b""] and rows[8] == [b"the"] * 2 and rows[6] == [b""] and rows[11] == [b" tail"] and len(rows[None]) == 2
    assert suffix.repeated_strings(nothing).count() == 0


# 9 -----------------------------------------------------------------------------------


def brute_hits(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            grams[tuple(w[k : k + window])].add(str(i) if i is not None else "null")
    out = []
    for t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block_words", [250_000, 30])
def test_decontamination_against_brute_force(spark, block_words):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice(["a", "B", "c", "dé", "7"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 4, 6, 9]) + 2)) for i in range(25)] + [(None, "null item here we go on"), (30, None), (31, ""), (32, "!!"), (1, "second text of one")]
    docs = [None, "", "!"] + [text(r.randint(1, 60)) for _ in range(60)] + [". ".join([text(5), items[3][1].upper(), text(4)]) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    found = decontam.search(df, spark.createDataFrame(items, "item_id long, text string"), window=5, block_words=block_words)
    got = {x.doc_id: (x.found["n_words"], x.n, list(x.found["items"])) for x in found.withColumn("n", decontam.hit_words()).collect()}
    assert [got[i] for i in range(len(docs))] == brute_hits(docs, items, 5)


@pytest.mark.parametrize("block_words", [250_000, 8])
def test_passages_side_by_side_are_one_cut(spark, block_words):
    passages = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(6)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    docs = [(k, prose(k, 60) + " | " + " -- ".join(passages[k % 6 : k % 6 + 2]) + " | " + prose(k + 50, 60)) for k in range(5)]
    got = {r.doc_id: r.text for r in decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items, block_words=block_words).collect()}
    assert got == {k: prose(k, 60) + " |  | " + prose(k + 50, 60) for k in range(5)}


@pytest.mark.parametrize("block_words", [250_000, 8])
def test_decontamination_cuts(spark, block_words):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11")], "item_id long, text string")
    rows = [(1, prose(1, 40) + " " + item.upper() + "! " + prose(2, 40)), (2, item), (3, prose(3, 20)), (4, None), (5, "one two three four five six seven eight nine")]
    got = {r.doc_id: r.text for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items, block_words=block_words).collect()}
    assert got == {1: prose(1, 40) + " ! " + prose(2, 40), 3: rows[2][1], 4: None, 5: rows[4][1]}


def test_decontamination_awkward(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(awkward, none).count() == 16 and own_columns_stay(decontam.search(awkward, none).collect())
    items = spark.createDataFrame([(1, prose(2, 120)), (2, "the the")], "item_id long, text string")
    for block_words in (250_000, 5):
        assert {r.doc_id for r in decontam.search(awkward, items, block_words=block_words).where("size(found_.items) > 0").collect()} == {1, 2}
        left = decontam.decontaminate(awkward, items, block_words=block_words).collect()
        assert own_columns_stay(left) and len(left) == 14
    assert decontam.search(nothing, none).count() == 0 and decontam.decontaminate(awkward, none).columns == awkward.columns


# 10 ----------------------------------------------------------------------------------


def test_trees_are_walked_like_trees():
    r = np.random.Generator(np.random.PCG64(12))
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    t = quality.fit(x, y, rounds=15, depth=3)
    want = []
    for row in x[:50]:
        total = t.start
        for f, c, v in zip(t.feature, t.threshold, t.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += v[at - len(f)]
        want.append(total)
    assert np.allclose(t.margin(x[:50]), want) and ((t.score(x) > 0.5) == y).mean() > 0.97


def test_statistics_by_hand():
    f = dict(zip(quality.FEATURES, quality.statistics(["Ab ab ab,\nAb cd!!\nAb cd!!", None, ""])[0]))
    assert f["upper"] == 3 / 25 and f["repeated_lines"] == 1 / 3 and f["distinct_words"] == 4 / 7 and f["log_words"] == pytest.approx(math.log(8)) and f["newline"] == 2 / 25 and f["marked_words"] == 2 / 7
    assert not quality.statistics([None, ""]).any()


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and rows.score.between(0, 1).all()


def test_quality_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (10, 0), (8, 1), (8, 0), (None, 1), (12, None), (99, 0)], "doc_id long, quality int")
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == 16 and all(0 <= r.score_ <= 1 for r in rows) and [r.held_out_ for r in rows if r.doc_id is None] == [True, True] and own_columns_stay(rows)
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score_ for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert own_columns_stay(quality.keep_good(awkward, labels).collect())


def test_quality_sample_has_a_bound(spark, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **o: seen.append(len(y)) or fit(x, y, **o))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)] + [(i, i % 2) for i in range(2, 60)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, prose(i, 20)) for i in range(2, 60)], "doc_id long, text string")
    quality.train(docs, labels, train_rows=50)
    quality.train(docs, labels)
    assert seen[0] == min(50, seen[0]) and seen[1] > 600


def brute_split(x, y, g, h, edges, least, ridge):
    """The best gain of one node over all features and cuts."""
    best = 0.0
    for f in range(x.shape[1]):
        for e in edges[f]:
            left = x[:, f] <= e
            if h[left].sum() >= least and h[~left].sum() >= least:
                gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
                best = max(best, gain(left) + gain(~left) - gain(np.ones(len(y), bool)))
    return best


def test_each_split_has_the_best_gain():
    r = np.random.Generator(np.random.PCG64(34))
    x = r.integers(0, 9, (200, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6) ^ (r.random(200) < 0.1)).astype(float)
    import inspect

    given = {k: v.default for k, v in inspect.signature(quality.fit).parameters.items()}
    t = quality.fit(x, y, rounds=1, depth=2)
    p = 1 / (1 + np.exp(-t.start))
    g, h = y - p, np.full(200, p * (1 - p))
    edges = [np.arange(9.0)] * 3  # a cut between two values is one at the lower of them
    at = np.zeros(200, int)
    for node, rows in ((0, np.ones(200, bool)), (1, None), (2, None)):
        rows = rows if rows is not None else at == node
        f, c = t.feature[0][node], t.threshold[0][node]
        left = rows & (x[:, f] <= c)
        right = rows & ~left
        gain = sum(g[m].sum() ** 2 / (h[m].sum() + given["ridge"]) for m in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + given["ridge"])
        assert gain == pytest.approx(brute_split(x[rows], y[rows], g[rows], h[rows], edges, given["least"], given["ridge"]))
        if node == 0:
            at = np.where(left, 1, 2)


def test_language_predictions_against_brute_force(spark):
    texts = {"aa": ["kala mala tala"] * 3, "bb": ["the fox jumps over"] * 3, "cc": ["ñandú año señor"] * 3}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, f"{t} {k}") for lang, ts in texts.items() for k, t in enumerate(ts))]
    rows += [(100 + k, t, None) for k, t in enumerate(["mala kala", "a fox", "señor año the", "12", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df).collect()

    def vector(text):
        total = np.zeros(langid.DIM)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            v = langid.letter_vectors(np.array([0, *map(ord, word), 0], np.uint32)).astype(float)
            for i in range(len(v) - 2):
                total += np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2]
        return total

    import zlib

    proto = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            proto[lang] = proto.get(lang, 0) + vector(t)
    for r in out:
        v = vector(r.text)
        best = max((v @ p / np.linalg.norm(v) / np.linalg.norm(p), lang) for lang, p in proto.items()) if v.any() else (0, "und")
        assert r.lang_pred == best[1] and r.score == pytest.approx(max(best[0], 0), abs=1e-5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_memory_has_a_bound():
    import tracemalloc

    r = random.Random(33)
    text = "".join(chr(0x4E00 + r.randrange(20000)) for _ in range(300_000))
    langid.letters()
    tracemalloc.start()
    [(of, vectors, _)] = [b for b in langid.bundled([text]) if len(b[0])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and vectors.shape == (1, langid.DIM)


def enumerated(field, text, base):
    """The best segmentation by trying all of them; what follows a token is tried once."""
    toks = pii.tokens(text, 0, len(text))
    by_start = collections.defaultdict(list)
    for j, found in field.segments(text, toks, base).items():
        for i, kind, fs in found:
            by_start[i].append((j, kind, field.score(kind, fs)))
    after = field.weights.get(("after", ""), 0.0)

    @functools.cache
    def best(i, was):
        if i == len(toks):
            return 0.0, ()
        return max([best(i + 1, 0)] + [(s + own + (after if was else 0.0), ((kind, toks[i][0], toks[j - 1][1]), *rest)) for j, kind, own in by_start[i] for s, rest in [best(j, 1)]], key=lambda x: x[0])

    return best(0, 0)


def test_field_search_against_all_segmentations():
    field, r = pii.trained(), random.Random(31)
    for _ in range(60):
        text = " ".join(r.choice(["(555) 123-4567", "4111111111111111", "ann at mail dot com", "10.0.0.1", "x", "20", "card", "+1 555", "5555", "a@b.co"]) for _ in range(r.randint(1, 4)))
        base = pii.Known(pii.base_spans(text))
        total, spans = enumerated(field, text, base)
        got = field.best(text, 0, len(text), base)
        toks = pii.tokens(text, 0, len(text))
        score = {(k, toks[i][0], toks[j - 1][1]): field.score(k, fs) for j, found in field.segments(text, toks, base).items() for i, k, fs in found}
        next_to = sum(any(b[1] == toks[t + 1][0] for b in got) for a in got for t in [next(t for t, x in enumerate(toks) if x[1] == a[2])] if t + 1 < len(toks))
        assert sum(score[g] for g in got) + next_to * field.weights.get(("after", ""), 0.0) == pytest.approx(total), text


def test_long_stretches_are_searched_whole(monkeypatch):
    field, r = pii.trained(), random.Random(32)
    parts = ["(555) 123-4567", "ann at mail dot com", "12 34 56 78", "4111111111111111 5500005555555559", "10.0.0.1", "call me at 20"]
    text = " ".join(r.choice(parts) for _ in range(12_000))
    assert len(text) > 170_000
    known = pii.find(text, field)
    monkeypatch.setattr(pii, "TOKENS_AT_ONCE", 10**9)
    assert known == pii.find(text, field) and sum(not b for *_, b in known) > 1000


def test_residues_are_of_the_substring():
    r = np.random.Generator(np.random.PCG64(30))
    buf = r.integers(0, 4, 5000).astype(np.uint8)
    buf[3000:3700] = buf[100:800]
    p = common.Residues().load(buf)
    a, b = np.arange(100, 500), np.arange(3000, 3400)
    assert (p.of(a, a + 300) == p.of(b, b + 300)).all() and (p.of(a, a + 300) < 2**31 - 1).all()
    assert len(np.unique(p.of(np.arange(2000), np.arange(2000) + 60))) > 1990
    words = [int(common.Residues.WORDS[x]) for x in buf[7:20]]
    assert int(p.of(np.array([7]), np.array([20]))[0]) == sum(w * pow(common.Residues.BASE, k, 2**31 - 1) for k, w in enumerate(words)) % (2**31 - 1)


def test_stretches_find_what_the_whole_text_holds():
    """The search around anchors against one search over the whole text: nothing depends on what stands elsewhere."""
    field, r = pii.trained(), random.Random(33)

    def whole(text):
        base = pii.base_spans(text)
        known = pii.Known(base)
        spans = {(k, s, e): True for k, s, e in base}
        for kind, s, e in field.best(text, 0, len(text), known):
            if not known.overlaps(s, e):
                spans.setdefault((kind, s, e), False)
        return sorted(((*k, b) for k, b in spans.items()), key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))

    parts = ["foo at bar.com", "please write to", "ann [at] mail.org", "Bob (at) host dot net", "ann at mail dot com", "at", "look at the sea", "card", ":", "is", "(555) 123-4567", "+1 555 123 4567", "4111111111111111", "4111 1111 1111 1111 5500 0055 5555 5559",
             "10.0.0.1", "1.2.3.4.5", "a@b.co", "@", "20", "٣٤٥", "x²", "12:30", "é à la", "call", "x" * 130, "y" * 205, "z" * 450, "-" * 260, " " * 40, "\n" * 3, " " * 230, "word " * 60, "at" * 3, "5" * 90, "+", "("]
    added = 0
    for _ in range(1500):
        text = r.choice([" ", " ", "", "\n"]).join(r.choice(parts) + r.choice(["", " ", ".", ", "]) for _ in range(r.randint(1, 14)))
        found = pii.find(text, field)
        assert found == whole(text), text
        added += sum(not b for *_, b in found)
        stretches = list(pii.regions(text))
        assert all(a < b for a, b in stretches) and all(x[1] < y[0] for x, y in zip(stretches, stretches[1:]))
    assert added > 300
    for room in ("", "in room 7 "):  # a span does not come and go with unrelated text
        assert [("email", "foo at bar.com")] == [(k, f"{room}please write to foo at bar.com today"[s:e]) for k, s, e, _ in pii.find(f"{room}please write to foo at bar.com today", field)]
