"""Removal of long repeated strings by blockwise sorting of suffixes with a difference cover.

Any two equal strings of `length` bytes contain, at one offset below the cover's
period, a pair of positions that are both in the cover. So only the cover's
positions are ranked first: the prefixes of the cover's suffixes are dealt into
buckets by their fingerprints, one bucket is sorted at a time, and a position
keeps whether its prefix has an equal elsewhere. These ranks settle which of the
suffixes in between can tie over the whole length; their strings go through the
same buckets, again sorted one at a time. Since only equality counts here,
buckets are ranges of fingerprints and not of text, which keeps them alike in
size whatever the text.

A string's bucket comes from sums modulo a prime and its key within the bucket
from other sums modulo 2**64, so two different strings count as equal with
probability 2**-64 / buckets. Buckets grow with the text: among n strings that
can tie, about n * n / (2**65 * buckets) are false, that is 1e-8 in 30 GB and
under 1 in 100 TB of text with as many repeats as the check tables have.

Text is packed into compressed blocks that are written once. Between blocks and
buckets only packed arrays of fingerprints and bit maps travel; each block sends
a fingerprint once, so very frequent strings fill no bucket. A block's keys for
a bucket are one row, if there are any: at most as many rows as keys, however
many blocks and buckets there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import Fingerprints, Residues, chunks, loaded, materialise, prepare

BLOCK = "block long, data binary, doc_ids array<long>, sizes array<long>"
KEYS = "kind int, bucket int, block long, keys binary"
FLAGS = "block long, kind int, bucket int, flags binary"
RESULT = "doc_id long, kept binary, spans array<struct<first:long,last:long>>"
TEXTS, COVER, WINDOWS = range(3)
#: Keys of whole texts, of the cover's prefixes (a filter, so few bits are enough within a bucket), of windows.
DTYPE = {TEXTS: np.dtype("V16"), COVER: np.dtype("<u4"), WINDOWS: np.dtype("<u8")}
#: Bytes of a block of text, and of keys in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 16_000_000
#: Bytes that a task of a shuffle reads at most, but for a document that is longer.
TASK_BYTES = 64_000_000
PRINTS, RESIDUES = Fingerprints(), Residues()


def difference_cover(period_limit: int) -> tuple[int, np.ndarray]:
    """(period, members): of the largest perfect difference set with period q*q + q + 1 within the limit, q prime.

    Powers of a generator x of GF(q**3) that lie in the plane without x**2 have
    exponents whose differences are each residue once (Singer). A limit below 7
    gives the trivial cover.
    """
    prime = lambda n: n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))
    for q in range(int(period_limit**0.5), 1, -1):
        v = q * q + q + 1
        if v > period_limit or not prime(q):
            continue
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    members, x = [], (1, 0, 0)
                    for i in range(v):
                        if x[2] == 0:
                            members.append(i)
                        x = (c * x[2] % q, (x[0] + b * x[2]) % q, (x[1] + a * x[2]) % q)
                    d = np.array(members)
                    if len(d) == q + 1 and len(np.unique((d[:, None] - d) % v)) == v:
                        return v, d
    return 1, np.zeros(1, np.int64)


def _pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def made():
        data = zstandard.ZstdCompressor(3).compress(b"".join(b for _, b in held))
        return pd.DataFrame({"block": [block], "data": [data], "doc_ids": [[i for i, _ in held]], "sizes": [[len(b) for _, b in held]]})

    size = 0
    for part in parts:
        ids = [None if pd.isna(i) else int(i) for i in part["doc_id"]]
        for first, rows in chunks(part["text"].tolist(), BLOCK_BYTES // 4):
            for i, b in enumerate(rows):
                if held and size + len(b) > BLOCK_BYTES:
                    yield made()
                    block, held, size = block + 1, [], 0
                held.append((ids[first + i], b))
                size += len(b)
    if held:
        yield made()


def packed_texts(docs: DataFrame) -> DataFrame:
    """The texts of docs (doc_id, text) in compressed blocks."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(_pack, BLOCK)


class Block:
    """A block's text with the keys that it sends."""

    def __init__(self, data: bytes, sizes, length: int, period: int, members: np.ndarray):
        sizes = np.asarray(sizes, np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(sizes.sum()) + 1) if sizes.sum() else b""
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.length, self.period = length, period
        self.long = np.flatnonzero(sizes >= length)
        self.prints = loaded(PRINTS, self.buf) if len(self.long) else None
        self.residues = loaded(RESIDUES, self.buf) if len(self.long) else None
        most = int(sizes.max(initial=0))
        self.sample = (np.arange(0, most + period, period)[:, None] + members).ravel()

    def texts(self) -> np.ndarray:
        """A digest of each text that is long enough."""
        return np.array([hashlib.md5(self.raw[self.starts[i] : self.ends[i]]).digest() for i in self.long], DTYPE[TEXTS]) if len(self.long) else np.zeros(0, DTYPE[TEXTS])

    def strings(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the strings that start there, and what says their buckets."""
        none = np.zeros(0, np.uint64)
        return (self.prints.of(at, at + length), self.residues.of(at, at + length)) if len(at) else (none, none)

    def cover(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The cover's positions with a whole prefix in their text, and these prefixes."""
        key = self.length - self.period + 1
        at = [self.sample[: np.searchsorted(self.sample, self.ends[i] - self.starts[i] - key, side="right")] + self.starts[i] for i in self.long]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return at, self.strings(at, key)

    def windows(self, positions: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Starts of the strings that hold one of the cover's positions, but for the texts to skip, and these strings."""
        if not len(positions):
            return np.zeros(0, np.int64), self.strings(positions, self.length)
        doc = np.searchsorted(self.ends, positions, side="right")
        low = np.maximum(positions - self.period + 1, self.starts[doc])
        high = np.minimum(positions, self.ends[doc] - self.length)
        ok = (low <= high) & ~skip[doc]
        step = np.zeros(len(self.buf) + 2, np.int32)
        np.add.at(step, low[ok], 1)
        np.add.at(step, high[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(step) > 0)
        return at, self.strings(at, self.length)


class Sent:
    """The distinct keys of one kind that a block sends, by bucket, and the answers for its positions."""

    def __init__(self, kind: int, strings: np.ndarray | tuple[np.ndarray, np.ndarray], buckets: int):
        self.kind, self.buckets = kind, buckets
        prints, residues = (strings, None) if kind == TEXTS else strings
        if kind == TEXTS:
            halves = prints.view(np.uint64).reshape(-1, 2)
            order = np.lexsort((halves[:, 1], halves[:, 0]))
            self.keys, self.at = halves[order], order
            new = np.ones(len(order), bool)
            new[1:] = (self.keys[1:] != self.keys[:-1]).any(1)
            self.number = np.empty(len(order), np.int64)
            self.number[order] = np.cumsum(new) - 1
            self.first = order[new]  # the first of equal ones, since lexsort is stable
            self.keys = self.keys[new]
            where = ((self.keys[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        else:
            bucket = (residues * np.uint64(buckets)) >> np.uint64(31)
            if kind == COVER:
                self.keys, self.number = np.unique(bucket << np.uint64(32) | prints & np.uint64(0xFFFFFFFF), return_inverse=True)
                where, self.keys = self.keys >> np.uint64(32), self.keys & np.uint64(0xFFFFFFFF)
            else:
                # In a block two strings with one fingerprint are taken for equal, wherever their buckets are.
                self.keys, first, number = np.unique(prints, return_index=True, return_inverse=True)
                order = np.argsort(bucket[first], kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                self.keys, where, self.number = self.keys[order], bucket[first][order], place[number]
        self.own = np.bincount(self.number, minlength=len(self.keys)) > 1
        self.bounds = np.searchsorted(where, np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, block: int) -> list[tuple]:
        packed = self.keys.view(DTYPE[TEXTS]).ravel() if self.kind == TEXTS and len(self.keys) else self.keys.astype(DTYPE[self.kind]) if self.kind != TEXTS else np.zeros(0, DTYPE[TEXTS])
        spans = zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())
        return [(self.kind, k, block, packed[a:b].tobytes()) for k, (a, b) in enumerate(spans) if b > a]

    def answers(self, rows, of: int = 0, parts: int = 1) -> np.ndarray:
        """For each distinct key, one of the bits that its bucket has answered."""
        out = np.zeros(len(self.keys), bool)
        for bucket, flags in rows:
            a, b = self.bounds[bucket], self.bounds[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=parts * (b - a))[of * (b - a) : (of + 1) * (b - a)]
        return out


def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For the rows of one bucket: which keys other blocks have too; for texts also in which block each comes first."""
    rows = rows.sort_values("block", kind="stable")
    kind = int(rows["kind"].iloc[0])
    parts = [np.frombuffer(k, DTYPE[kind]) for k in rows["keys"]]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    first[order[1:]] = ~same
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    flags = [np.packbits(np.concatenate((again[a:b], first[a:b])) if kind == TEXTS else again[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
    return pd.DataFrame({"block": rows["block"].to_numpy(), "kind": kind, "bucket": rows["bucket"].to_numpy(), "flags": flags})


def repeated_strings(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """(doc_id, kept, spans): each text of docs (doc_id, text) without the bytes of repeated strings.

    A byte goes if it is in a string of `length` bytes that also starts anywhere
    else, in the same text or another; overlaps count, strings never cross
    texts and are judged on the input. kept has the other bytes in order, and
    spans the maximal removed runs as byte offsets.

    Null texts are empty; texts shorter than length stay whole. Repeated rows
    are texts of their own, so a text of at least length bytes that occurs twice
    goes entirely. A null doc_id stays null. Extra columns are ignored; without
    rows there are no rows. Strings are equal if their fingerprints are, of 64
    bits within a bucket of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    period, members = difference_cover((length + 1) // 2)
    blocks = materialise(packed_texts(docs), "blocks", "none")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    spread = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Were every string of the text a key, no bucket would hold more than four times BUCKET_BYTES.
    buckets = max(spread, -(-total * 2 // BUCKET_BYTES))
    of = lambda r: Block(r.data, r.sizes, length, period, members)
    # Where the session's number of partitions would make large tasks, there are more.
    tasks = -(-total // TASK_BYTES)
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks * 8 > spread else df
    sorted_ = lambda df: dealt(df, "kind", "bucket").groupBy("kind", "bucket").applyInPandas(sort_bucket, FLAGS)
    by_block = lambda df: dealt(df, "block").groupBy("block")

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                b = of(r)
                rows = Sent(TEXTS, b.texts(), buckets).rows(r.block) + Sent(COVER, b.cover()[1], buckets).rows(r.block)
                yield pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys"])

    def ties(r, flags: pd.DataFrame):
        """The block, its windows as sent, and which of its texts occur more than once."""
        b = of(r)
        by = {k: [(x.bucket, x.flags) for x in flags[flags["kind"] == k].itertuples()] for k in (TEXTS, COVER, WINDOWS)}
        t = Sent(TEXTS, b.texts(), buckets)
        copied, skip = np.zeros(len(b.ends), bool), np.zeros(len(b.ends), bool)
        copied[b.long] = (t.own | t.answers(by[TEXTS], 0, 2))[t.number] if len(b.long) else False
        leads = np.zeros(len(b.long), bool)
        if len(b.long):
            leads[t.first] = t.answers(by[TEXTS], 1, 2)
        skip[b.long] = copied[b.long] & ~leads
        at, prints = b.cover()
        c = Sent(COVER, prints, buckets)
        at, prints = b.windows(at[(c.own | c.answers(by[COVER]))[c.number]], skip)
        return b, at, Sent(WINDOWS, prints, buckets), copied, by[WINDOWS]

    def emit_ties(block: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        rows = [x for r in block.itertuples(index=False) for x in ties(r, flags)[2].rows(r.block)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys"])

    def cut(block: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in block.itertuples(index=False):
            b, at, sent, copied, answers = ties(r, flags)
            hit = at[(sent.own | sent.answers(answers))[sent.number]] if len(at) else at
            step = np.zeros(len(b.buf) + 1, np.int32)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            for i in np.flatnonzero(copied):
                gone[b.starts[i] : b.ends[i]] = True
            edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
            for i, doc_id in enumerate(r.doc_ids):
                s, e = int(b.starts[i]), int(b.ends[i])
                turns = edge[np.searchsorted(edge, s, side="right") : np.searchsorted(edge, e)].tolist()
                bounds, inside = [s, *turns, e], s < e and bool(gone[s])
                removed = list(zip(bounds[:-1], bounds[1:]))[0 if inside else 1 :: 2] if s < e else []
                stay = list(zip(bounds[:-1], bounds[1:]))[1 if inside else 0 :: 2]
                spans = [{"first": x - s, "last": y - s} for x, y in removed]
                out.append((doc_id, b"".join(b.raw[x:y] for x, y in stay), spans))
        return pd.DataFrame(out, columns=["doc_id", "kept", "spans"])

    flags = materialise(sorted_(blocks.mapInPandas(emit, KEYS)), "flags")
    joined = by_block(blocks).cogroup(by_block(flags))
    more = materialise(sorted_(joined.applyInPandas(emit_ties, KEYS)), "more_flags")
    return by_block(blocks).cogroup(by_block(flags.unionByName(more))).applyInPandas(cut, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    out = repeated_strings(docs).withColumn("n_removed", removed)
    return out.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
