"""Removal of long repeated passages of words by anchors at the positions of a difference cover.

Two equal passages of `window` words contain, at one offset below the cover's
period, a pair of words whose places in their texts are both in the cover
modulo the period. So only there an anchor is hashed, the window - period + 1
words that follow: any two equal windows share an aligned pair of equal anchors.
Anchors are dealt into buckets by their hash; a bucket says which of them occur
more than once. Each of these is then extended to the windows that hold it, and
the windows' hashes meet in buckets in the same way, whatever the number of
copies: no pairs are made.

Anchors and windows are compared by hashes of their words' 64-bit fingerprints:
windows by 64 bits beside a bucket that an independent hash of 31 bits gives.
Among n windows that hold repeated anchors some n * n / (2**65 * buckets) pairs
are false, under 1 in 100 TB. A bucket's answers go back to its blocks of
compressed text as bit maps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import SPACE, Fingerprints, loaded, materialise, mix, prepare, runs
from sondage.llm.suffix import BUCKET_BYTES, COVER, FLAGS, KEYS, TASK_BYTES, WINDOWS, Sent, difference_cover, packed_texts, sort_bucket

RESULT = "doc_id long, n_words long, kept binary, spans array<struct<first:long,last:long>>"
PRINTS = Fingerprints()
#: Makes the second fingerprint of a word from its first.
OTHER = np.uint64(0xA0761D6478BD642F)


class Words:
    """The words of a block of texts, with the anchors and windows that it sends."""

    def __init__(self, data: bytes, sizes, window: int, period: int, members: np.ndarray):
        sizes = np.asarray(sizes, np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(sizes.sum()) + 1) if sizes.sum() else b""
        buf = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.window, self.period = window, period
        full = sizes > 0
        word = ~SPACE[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[self.starts[full]] = word[self.starts[full]]  # whatever text stands beside this one
        last[self.ends[full] - 1] = word[self.ends[full] - 1]
        at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.low, self.high = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends)  # each text's words
        self.long = np.flatnonzero(self.high - self.low >= window)
        if len(self.long):
            prints = loaded(PRINTS, buf)
            up, self.down = prints._up[: len(at)], prints._down
            words = prints.of(at, to)
            self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64))) for h in (words, mix(words ^ OTHER))]
        most = int((self.high - self.low).max(initial=0))
        self.sample = (np.arange(0, most + period, period)[:, None] + members).ravel()

    def passages(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the passages that start at these words, and 31 bits of another hash for their buckets."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one, two = (mix((s[at + length] - s[at]) * self.down[at]) for s in self.sums)
        return one, two >> np.uint64(33)

    def anchors(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The cover's words that have an anchor within their text, and these anchors."""
        length = self.window - self.period + 1
        at = [self.sample[: np.searchsorted(self.sample, self.high[i] - self.low[i] - length, side="right")] + self.low[i] for i in self.long]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return at, self.passages(at, length)

    def extended(self, anchors: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Where the windows that hold one of the anchors start, and these windows."""
        if not len(anchors):
            return np.zeros(0, np.int64), self.passages(anchors, self.window)
        text = np.searchsorted(self.high, anchors, side="right")
        low = np.maximum(anchors - self.period + 1, self.low[text])
        high = np.minimum(anchors, self.high[text] - self.window)
        at = np.flatnonzero(covered(low[low <= high], high[low <= high] + 1, len(self.sums[0])))
        return at, self.passages(at, self.window)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [first, last)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def repeated_words(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """(doc_id, n_words, kept, spans): each text of docs (doc_id, text) without its repeated passages.

    Words are what white space (the six ASCII bytes) separates, unchanged. A
    word goes if it is in `window` consecutive words of its text that also start
    anywhere else, in the same text or another; overlaps count, and passages are
    judged on the input. kept has the other words joined by one space, spans the
    maximal removed runs as word offsets.

    Null texts have no words; a text of fewer than window words keeps all.
    Repeated rows are texts of their own, so a text of at least window words
    that occurs twice goes entirely. A null doc_id stays null. Extra columns are
    ignored; without rows there are no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    period, members = difference_cover((window + 1) // 2)
    blocks = materialise(packed_texts(docs), "blocks", "none")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    spread = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A word and the space after it are two bytes at least, its window's key is of eight.
    buckets = max(spread, -(-total * 4 // BUCKET_BYTES))
    of = lambda r: Words(r.data, r.sizes, window, period, members)
    tasks = -(-total // TASK_BYTES)
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks * 8 > spread else df
    sorted_ = lambda df: dealt(df, "kind", "bucket").groupBy("kind", "bucket").applyInPandas(sort_bucket, FLAGS)
    by_block = lambda df: dealt(df, "block").groupBy("block")

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                yield pd.DataFrame(Sent(COVER, of(r).anchors()[1], buckets).rows(r.block), columns=["kind", "bucket", "block", "keys"])

    def extend(r, flags: pd.DataFrame):
        """The block, where the windows start that hold a repeated anchor, these windows as sent, and what was answered to them."""
        b = of(r)
        answers = lambda kind: [(x.bucket, x.flags) for x in flags[flags["kind"] == kind].itertuples()]
        at, passages = b.anchors()
        sent = Sent(COVER, passages, buckets)
        at, passages = b.extended(at[(sent.own | sent.answers(answers(COVER)))[sent.number]] if len(at) else at)
        return b, at, Sent(WINDOWS, passages, buckets), answers(WINDOWS)

    def emit_windows(block: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        rows = [x for r in block.itertuples(index=False) for x in extend(r, flags)[2].rows(r.block)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys"])

    def cut(block: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in block.itertuples(index=False):
            b, at, sent, answers = extend(r, flags)
            hit = at[(sent.own | sent.answers(answers))[sent.number]] if len(at) else at
            gone = covered(hit, hit + window, int(b.high[-1]) + 1 if len(b.high) else 1)
            for doc_id, s, e, low, high in zip(r.doc_ids, b.starts.tolist(), b.ends.tolist(), b.low.tolist(), b.high.tolist()):
                words, away = b.raw[s:e].split(), gone[low:high]
                first, last = runs(away) if away.any() else ((), ())
                spans = [{"first": int(x), "last": int(y)} for x, y in zip(first, last)]
                out.append((doc_id, high - low, b" ".join(compress(words, (~away).tolist()) if spans else words), spans))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "kept", "spans"])

    flags = materialise(sorted_(blocks.mapInPandas(emit, KEYS)), "flags")
    more = materialise(sorted_(by_block(blocks).cogroup(by_block(flags)).applyInPandas(emit_windows, KEYS)), "more_flags")
    out = by_block(blocks).cogroup(by_block(flags.unionByName(more))).applyInPandas(cut, RESULT)
    return out.withColumn("kept", F.col("kept").cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return repeated_words(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, unnest(list_transform(range(1, greatest(len(w) - 33, 1)), lambda k: md5(array_to_string(w[k:k + 34], ' ')))) AS m, unnest(range(1, greatest(len(w) - 33, 1))) AS k FROM d),
t AS (SELECT r, k FROM i QUALIFY count(*) OVER (PARTITION BY m) > 1),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
g AS (SELECT r, x.k, word, coalesce(max(t.k) OVER (PARTITION BY r ORDER BY x.k ROWS 34 PRECEDING) IS NOT NULL, false) AS gone FROM x LEFT JOIN t USING (r, k)),
a AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '') AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""
