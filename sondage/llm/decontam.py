"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import Fingerprints, chunks, joined, materialise, packed, prepare, replaced, runs, unpacked

#: Bytes of words: digits, letters and everything beyond ASCII; A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def words(rows: list[bytes], prints: Fingerprints):
    """Fingerprint, row, start and end of every word; starts and ends within the row."""
    buf, starts, _ = joined(rows, b"\n")
    ws, we = runs(WORD[buf])
    row = np.searchsorted(starts, ws, side="right") - 1
    return prints.load(LOWER[buf]).of(ws, we), row, ws - starts[row], we - starts[row]


class Automaton:
    """Suffix automaton of word sequences, with the items that each window belongs to.

    A window is `window` consecutive words of an item, or the whole of a shorter
    item. Words that no item has end every match, so only runs of known words
    that are as long as the shortest window are walked.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.vocabulary = np.unique(np.array([w for _, ws in items for w in ws], np.uint64))
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items: dict[tuple[int, ...], set[str]] = {}
        whole: dict[int, set[int]] = {}
        for name, ws in items:
            ids = np.searchsorted(self.vocabulary, np.array(ws, np.uint64)).tolist()
            state = 0
            for w in ids:
                state = self._add(state, w)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.items.setdefault(tuple(ids[i : i + n]), set()).add(name)
        self.least = min(map(len, self.items), default=0)
        # Short items: those that end in a state are suffixes of all that its descendants by link hold.
        for gram in self.items:
            if len(gram) < window:
                state = 0
                for w in gram:
                    state = self.next[state][w]
                whole.setdefault(state, set()).add(len(gram))
        self.short: list[tuple[int, ...]] = [()] * len(self.next)
        if whole:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.short[s] = self.short[self.link[s]] + tuple(sorted(whole.get(s, ())))

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def spans(self, ids: list[int]):
        """(start, end) of each window that occurs in the words."""
        nxt, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        state = matched = 0
        for i, w in enumerate(ids):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if matched >= window:
                yield i + 1 - window, i + 1
            for m in short[state]:
                if m <= matched:
                    yield i + 1 - m, i + 1

    def search(self, rows: list[bytes], prints: Fingerprints):
        """Words of each row; and of each row with hits: the row, runs of hit words, their bytes, the items."""
        n = np.zeros(len(rows), np.int64)
        found, row, ws, we = words(rows, prints)
        np.add.at(n, row, 1)
        hits: dict[int, tuple[list, list, set]] = {}
        if not self.least or not len(found):
            return n, hits
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == found
        first = np.concatenate(([0], np.cumsum(n)))
        cut = np.flatnonzero(np.diff(row)) + 1
        starts, ends = runs(known)
        # Runs of known words end with their row.
        bounds = np.unique(np.concatenate((starts, cut[known[cut] & known[cut - 1]])))
        stops = np.unique(np.concatenate((ends, cut[known[cut] & known[cut - 1]])))
        long = stops - bounds >= self.least
        for a, b in zip(bounds[long].tolist(), stops[long].tolist()):
            ids = at[a:b].tolist()
            hit = np.zeros(b - a, bool)
            items: set[str] = set()
            for s, e in self.spans(ids):
                hit[s:e] = True
                items |= self.items[tuple(ids[s:e])]
            if items:
                r = int(row[a])
                spans, cuts, names = hits.setdefault(r, ([], [], set()))
                for s, e in zip(*runs(hit)):
                    spans.append((int(a + s - first[r]), int(a + e - first[r])))
                    cuts.append((int(ws[a + s]), int(we[a + e - 1])))
                names |= items
        return n, hits


RESULT = "n_words long, spans array<struct<first:long,last:long>>, cuts array<struct<first:long,last:long>>, items array<string>"


def _search_udf(automaton):
    @F.pandas_udf(RESULT)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints()
        for texts in parts:
            out = []
            named = lambda pairs: [{"first": a, "last": b} for a, b in pairs]
            for _, rows in chunks(texts.tolist()):
                n, hits = automaton.value.search(rows, prints)
                for i, k in enumerate(n.tolist()):
                    spans, cuts, items = hits.get(i, ((), (), ()))
                    out.append((k, named(spans), named(cuts), sorted(items)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "cuts", "items"])

    return search


def cut(text: bytes, spans) -> bytes:
    """Text without the spans, which are in order."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _clean_udf(automaton, max_words: int, max_coverage: float):
    """Whether a document stays, and its text; one function, so that a task needs one Python worker."""

    @F.pandas_udf("keep boolean, text string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints()
        for texts in parts:
            given = texts.tolist()
            keep, out = [True] * len(given), list(given)
            for start, rows in chunks(given):
                n, hits = automaton.value.search(rows, prints)
                for i, (spans, cuts, _) in hits.items():
                    hit = sum(b - a for a, b in spans)
                    keep[start + i] = hit <= int(n[i]) * max_coverage
                    if hit > max_words:
                        out[start + i] = cut(rows[i], cuts).decode()
            yield pd.DataFrame({"keep": keep, "text": pd.Series(out, dtype=object)})

    return clean.asNondeterministic()


def _union(parts: pd.Series) -> pd.DataFrame:
    out = []
    named = lambda pairs: [{"first": a, "last": b} for a, b in pairs]
    for results in parts:
        spans = _merged([(s["first"], s["last"]) for r in results for s in r["spans"]])
        # From the first byte to the last of the runs that a merged run unites, so that side by side they lose what is between them.
        begin = {s["first"]: c["first"] for r in results for s, c in zip(r["spans"], r["cuts"])}
        end = {s["last"]: c["last"] for r in results for s, c in zip(r["spans"], r["cuts"])}
        cuts = [(begin[a], end[b]) for a, b in spans]
        out.append((max(r["n_words"] for r in results), named(spans), named(cuts), sorted({i for r in results for i in r["items"]})))
    return pd.DataFrame(out, columns=["n_words", "spans", "cuts", "items"])


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automata(docs: DataFrame, items: DataFrame, window: int, block_words: int):
    """Number of blocks of items, and a function that makes and sends the automaton of one."""
    spark = docs.sparkSession
    prepare(spark)
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x80-\x{10FFFF}]+")))).first()[0] or 0
    blocks = -(-total // block_words) or 1

    def automaton(block: int):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted((r["item_id"], r["text"]) for r in part.distinct().toLocalIterator())
        found, prints = [], Fingerprints()
        for first, texts in chunks([t for _, t in rows]):
            w, row, _, _ = words(texts, prints)
            found += [(rows[first + i][0], w[row == i].tolist()) for i in range(len(texts))]
        return spark.sparkContext.broadcast(Automaton(found, window))

    return blocks, automaton


def search(docs: DataFrame, items: DataFrame, *, window: int = 10, block_words: int = 250_000) -> DataFrame:
    """docs with the column `found`: n_words, spans (runs of hit words), cuts (their bytes) and items.

    Items are dealt into blocks of about block_words words by a hash, and each
    block's automaton alone is sent to the executors. With more than one block
    the documents are numbered and written once, and the hits that the blocks
    find in a document are united.

    Null and empty texts have no words, and items without words no windows.
    Repeated items change nothing; an item whose id is null is named `null`.
    Without items nothing is hit. All columns of docs stay (if one is called
    found, the result is `found_`).
    """
    found = _searched(packed(docs, text=F.col("text")), items, window, block_words)
    return unpacked(found, docs, found=F.col("found"))


def _searched(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """docs (packed rows with their text) with `found`."""
    blocks, automaton = _automata(docs, items, window, block_words)
    if blocks == 1:
        return docs.withColumn("found", _search_udf(automaton(0))("text"))
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = None
    for block in range(blocks):
        some = materialise(numbered.select("_row", _search_udf(automaton(block))("text").alias("found")), "block")
        parts = some if parts is None else parts.union(some)
    united = parts.groupBy("_row").agg(F.pandas_udf(_union, RESULT)(F.collect_list("found")).alias("found"))
    return numbered.join(united, "_row").drop("_row")


def hit_words(spans: str = "found.spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def _cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or not len(c) else cut(t.encode(), [(s["first"], s["last"]) for s in c]).decode() for t, c in zip(texts, cuts)], dtype=object)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, max_words: int = 0, max_coverage: float = 0.5, block_words: int = 250_000) -> DataFrame:
    """docs without their benchmark passages.

    Documents with more than max_words hit words lose these (the bytes from the
    first to the last word of each hit run); those of which more than
    max_coverage of the words are hit go. Others stay as they are, as do all
    other columns whatever their names. Nulls as in search().
    """
    rows = packed(docs, text=F.col("text"))
    blocks, automaton = _automata(rows, items, window, block_words)
    if blocks == 1:
        out = rows.withColumn("clean", _clean_udf(automaton(0), max_words, max_coverage)("text")).where("clean.keep")
        return replaced(out, docs, "text", F.col("clean.text"))
    out = _searched(rows, items, window, block_words).withColumn("hit", hit_words())
    out = out.where(F.col("hit") <= F.col("found.n_words") * max_coverage)
    clean = F.when(F.col("hit") > max_words, F.pandas_udf(_cut, "string")("text", "found.cuts")).otherwise(F.col("text"))
    return replaced(out, docs, "text", clean)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", F.col("found.n_words").alias("n_words"), hit_words().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest([w[i:i + least(10, len(w)) - 1] FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS g FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT len(g) AS m FROM bg),
dg AS (SELECT r, m, i, w[i:i + m - 1] AS g FROM (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
hit AS (SELECT r, m, i, item_id FROM dg JOIN bg USING (g)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
