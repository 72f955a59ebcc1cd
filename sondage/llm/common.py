"""What several corpus operators share: written intermediates, components, hashing and buffers in numpy."""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondage.session import ship
from sondage.sources.files import scratch


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Before Python code on executors: they get the package, and Arrow batches are of at most 8 MB from now on
    unless the session has a limit of its own, since texts can be long. The limit must still hold when a result is
    computed, so it is not put back."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


#: The columns of a caller's row, as one struct.
OWN = "_own"


def _named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame, **used: Column) -> DataFrame:
    """docs' rows as one struct OWN, beside the columns that an operator reads under names of its own: whatever docs'
    columns are called, none of them can clash with the operator's."""
    return docs.select(F.struct(*[_named(c) for c in docs.columns]).alias(OWN), *[c.alias(n) for n, c in used.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **results: Column) -> DataFrame:
    """All columns of docs as they are, then the results. A result whose name docs has already, in whatever case, gets
    as many underscores behind it as make it new."""
    taken = {c.lower() for c in docs.columns}
    out = [F.col(OWN).getField(c).alias(c) for c in docs.columns]
    for name, c in results.items():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(c.alias(name))
    return rows.select(*out)


def replaced(rows: DataFrame, docs: DataFrame, column: str, by: Column) -> DataFrame:
    """All columns of docs in their order, one of them replaced."""
    return rows.select(*[(by if c == column else F.col(OWN).getField(c)).alias(c) for c in docs.columns])


def tidy(work):
    """The function of frames, which at its end gives back the memory that its worker would keep while idle."""

    def run(*parts):
        yield from work(*parts)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


#: Bits of a bitmap of rows, as a power of 2.
BITS = 26


def _bit(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))


def bitmap(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A bitmap of the columns' hashes with 2**BITS bits, whatever the number of rows: at most 2**(BITS - 15) rows of 4 kB."""
    bit = _bit(columns)
    return rows.groupBy(F.bitmap_bucket_number(bit).alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))


def by_bitmap(rows: DataFrame, bits: DataFrame, columns: list[str], inside: bool) -> DataFrame:
    """Rows whose bit is set, or those whose bit is not: of the rows that the bitmap was made from all are inside, and the
    more others the fuller it is."""
    at = F.bitmap_bit_position(_bit(columns))
    byte = F.conv(F.hex(F.substr("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_page", F.bitmap_bucket_number(_bit(columns))).join(F.broadcast(bits), "_page", "left")  # 8 MB at most
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return found.where(hit if inside else ~hit).drop("_page", "_bits")


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


# Hashing of byte strings in numpy ------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.ones(n + 1, np.uint64)
    if n:
        out[1] = base
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k + 1 : k + 1 + m] = out[1 : m + 1] * out[k]
        k += m
    return out


BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Fingerprints:
    """64-bit fingerprints of any substrings of a buffer, from prefix sums of base**i * word(byte i)."""

    def __init__(self, limit: int = 0):
        self._up = self._down = np.ones(1, np.uint64)
        self._grow(limit)

    def _grow(self, n: int) -> None:
        if len(self._up) <= n:
            self._up, self._down = powers(BASE, n), powers(UNBASE, n)

    def load(self, buf: np.ndarray) -> Fingerprints:
        self._grow(len(buf))
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE_WORDS[buf] * self._up[: len(buf)], out=self._sums[1:])
        return self

    def of(self, start: np.ndarray, end) -> np.ndarray:
        """Of buf[start:end], for arrays of starts and ends."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


class Residues:
    """31-bit fingerprints of any substrings of a buffer, from prefix sums modulo a prime: independent of Fingerprints, and
    without the weakness that sums modulo a power of 2 have against texts made for it."""

    PRIME, BASE = (1 << 31) - 1, 1_103_515_245
    WORDS = BYTE_WORDS % np.uint64(PRIME)

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint32)

    @classmethod
    def _mod(cls, x: np.ndarray) -> np.ndarray:
        """x modulo the prime, in its place: 2**31 is 1, so the upper bits are added to the lower."""
        p, bits = np.uint64(cls.PRIME), np.uint64(31)
        for _ in range(2):
            high = x >> bits
            x &= p
            x += high
        high = (x >= p).astype(np.uint64)
        high *= p
        x -= high
        return x

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        out = np.ones(n + 1, np.uint32)
        k = 1
        while k <= n:
            m = min(k, n + 1 - k)
            out[k : k + m] = cls._mod(out[:m] * np.uint64(pow(base, k, cls.PRIME)))
            k += m
        return out

    def _grow(self, n: int) -> None:
        if len(self._up) <= n:
            self._up, self._down = self._powers(self.BASE, n), self._powers(pow(self.BASE, -1, self.PRIME), n)

    def load(self, buf: np.ndarray) -> Residues:
        self._grow(len(buf))
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        words = self.WORDS[buf]
        words *= self._up[: len(buf)]
        np.cumsum(self._mod(words), out=self._sums[1:])
        return self

    def of(self, start: np.ndarray, end) -> np.ndarray:
        """Of buf[start:end], for arrays of starts and ends."""
        found = self._mod(self._sums[end] - self._sums[start])
        found *= self._down[start]
        return self._mod(found)


def loaded(tables: Fingerprints | Residues, buf: np.ndarray):
    """A view of the tables for one buffer; the powers are made once for all of them."""
    tables._grow(len(buf))
    return copy(tables).load(buf)


# Texts as byte buffers -----------------------------------------------------------

CHUNK = 500_000


def chunks(texts, limit: int = CHUNK):
    """(first row, byte strings) of consecutive runs of texts of about limit bytes; null is empty."""
    rows, total, first = [], 0, 0
    for i, t in enumerate(texts):
        if isinstance(t, str):
            b = t.encode("utf-8", "surrogatepass")
        else:
            b = bytes(t) if t is not None and t == t else b""
        if rows and total + len(b) > limit:
            yield first, rows
            rows, total, first = [], 0, i
        rows.append(b)
        total += len(b)
    if rows:
        yield first, rows


def joined(rows: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in one buffer, each followed by gap; their starts and ends."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    ends = np.cumsum(sizes + len(gap)) - len(gap) if len(rows) else sizes
    return np.frombuffer(gap.join(rows) + gap, np.uint8), ends - sizes, ends


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: The six ASCII white space bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def whole_groups(parts, columns: list[str]):
    """From sorted frames: (rows, group numbers) of consecutive whole groups; a group may go across frames."""
    held = None
    number = lambda rows: rows.groupby(columns, sort=False).ngroup().to_numpy()
    for part in parts:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        if len(held):
            group = number(held)
            done = int(np.searchsorted(group, group[-1]))
            if done:
                yield held.iloc[:done].reset_index(drop=True), group[:done]
                held = held.iloc[done:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, number(held)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges i-j span the components of n nodes, by union of trees."""
    root = list(range(n))
    keep = np.zeros(len(i), bool)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = top(a), top(b)
        if a != b:
            root[b] = a
            keep[k] = True
    return keep


def node_key(number: str, *hashes: str) -> Column:
    """Binary key that sorts by a long first; the 64-bit hashes after it tell apart what shares the number."""
    long = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(long(F.expr(f"{number} ^ (1L << 63)")), *[long(h) for h in hashes]))


def node_number(key: str) -> Column:
    """The long that a node_key begins with."""
    return F.expr(f"CAST(conv(hex(substring({key}, 1, 8)), 16, -10) AS BIGINT) ^ (1L << 63)")
