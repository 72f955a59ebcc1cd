"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import bitmap, by_bitmap, forest, materialise, mix, prepare, whole_groups
from sondage.operators.graph import components

#: Members of a bucket that are compared by codes alone, and of a part of a larger one, each pair of parts in its own group.
SMALL, PART = 32, 1024
BUCKET = ["t", "key", "dim"]
#: A bucket's key among those of a node's large buckets, -1 for none.
KEY = np.dtype(">i4")
#: How many deviations the confidence bound allows an estimate.
SIGMAS = 4.5
#: Chance that a pair right at the threshold meets in some bucket.
RECALL = 0.98


def rotations(dim: int, n: int, seed: int = 7) -> np.ndarray:
    """n random rotations of dim dimensions, side by side; the same on every machine."""
    r = np.random.Generator(np.random.PCG64(seed * 1_000_003 + dim))
    return np.concatenate([np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a bucket's key, number of tables): buckets of unrelated vectors stay small for n vectors, and RECALL holds.

    Two vectors at the threshold agree in a sign with probability
    1 - angle / pi, in all of a key's bits with its power.
    """
    bits = max(6, ceil(log2(max(n, 2))) + 2)
    same = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - RECALL) / log(1 - same)))


def nibbles(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in four bits a component, two of them in a byte, with each row's lowest value and step."""
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / 15, 1e-12)
    q = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    q = np.pad(q, ((0, 0), (0, q.shape[1] % 2)))
    return q[:, ::2] << 4 | q[:, 1::2], low.astype(np.float32), step.astype(np.float32)


def widened(packed: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int) -> np.ndarray:
    q = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    return q * step[:, None] + low[:, None]


def encode(unit: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign codes in the first rotation, their correction factors, the rows in that rotation, and the bucket keys of each table."""
    dim = unit.shape[1]
    turned = unit @ rotations(dim, max(1, ceil(bits * count / dim)))
    signs = turned > 0
    factor = np.abs(turned[:, :dim]).sum(1) / dim**0.5
    padded = np.zeros((len(unit), count, 64), np.uint8)
    padded[:, :, : min(bits, 64)] = signs[:, : bits * count].reshape(len(unit), count, bits)[:, :, :64]
    words = np.packbits(padded, axis=2).view(np.uint64)[:, :, 0]
    keys = (mix(words) & np.uint64(0x7FFFFFFF)).astype(np.int32)
    return np.packbits(signs[:, :dim], axis=1), factor.astype(np.float32), turned[:, :dim].astype(np.float32), keys


def signs_of(codes, dim: int) -> np.ndarray:
    """Unit vectors of sign codes."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return (np.unpackbits(raw, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(dim**0.5)


def bounds(factor: np.ndarray, dim: int, step: np.ndarray | float = 0.0) -> np.ndarray:
    """By how much an estimate may fall short: SIGMAS deviations, those of the code given its factor and of a rounding to steps.
    Nothing is estimated in one dimension."""
    if dim == 1:
        return np.full(len(factor), 9, np.float32)
    code = np.maximum(0, 1 - factor**2) / (dim - 1)
    return (SIGMAS * np.sqrt(code + np.square(step) / 12) / np.maximum(factor, 1e-6)).astype(np.float32)


class Members:
    """Rows of one large bucket, with what estimates and exact values need."""

    def __init__(self, rows: pd.DataFrame, dim: int, count: int):
        self.id = rows["id"].to_numpy()
        self.mult = rows["mult"].to_numpy()
        self.unit = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(-1, dim)
        self.codes = signs_of(rows["code"], dim)
        self.turned = (self.unit @ rotations(dim, 1)).astype(np.float32)
        self.factor = rows["factor"].to_numpy(np.float32)
        self.keys = np.frombuffer(b"".join(rows["large"]), KEY).reshape(-1, count)
        self.bound = bounds(self.factor, dim)


def _small(threshold: float, count: int):
    """Pairs of buckets of at most SMALL members that may be linked, by their estimates."""

    def estimated(rows: pd.DataFrame, group: np.ndarray, dim: int) -> pd.DataFrame:
        ids, factor, step = rows["id"].to_numpy(), rows["factor"].to_numpy(np.float32), rows["step"].to_numpy(np.float32)
        codes = signs_of(rows["code"], dim)
        turned = widened(np.frombuffer(b"".join(rows["query"]), np.uint8).reshape(len(rows), -1), rows["low"].to_numpy(np.float32), step, dim)
        none = np.full(count, -1, KEY).tobytes()
        large = np.frombuffer(b"".join(none if k is None else k for k in rows["large"]), KEY).reshape(-1, count)
        found = []
        for k in range(1, SMALL):
            i = np.flatnonzero(group[:-k] == group[k:]) if len(group) > k else np.zeros(0, int)
            if not len(i):
                break
            for a in range(0, len(i), 200_000):
                part = i[a : a + 200_000]
                j = part + k
                estimate = np.einsum("ij,ij->i", codes[part], turned[j]) / np.maximum(factor[part], 1e-6)
                # The deviation of the code, and of the other vector's four bits.
                near = estimate + bounds(factor[part], dim, step[j]) >= threshold
                # A pair that shares a large bucket is compared there.
                near &= ~((large[part] == large[j]) & (large[part] >= 0)).any(1)
                found.append(np.stack([ids[part[near]], ids[j[near]]]))
        both = np.sort(np.concatenate(found, axis=1), axis=0) if found else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": both[0], "b": both[1]})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in whole_groups(parts, BUCKET):
            for dim in rows["dim"].unique().tolist():
                mine = (rows["dim"] == dim).to_numpy()
                yield estimated(rows[mine].reset_index(drop=True), group[mine], dim)

    return compare


def _exact(threshold: float):
    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            linked = [float(np.dot(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64))) >= threshold for x, y in zip(rows["unit_a"], rows["unit_b"])]
            yield rows.loc[linked, ["a", "b", "mult_a", "mult_b"]]

    return exact


def _large(threshold: float, count: int):
    columns = ["a", "b", "n"]

    def counted(m: Members, i: np.ndarray, j: np.ndarray, table: int):
        """Link counts from pairs whose first common large bucket is in this table, and edges that span them."""
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= (m.keys[i, t] != m.keys[j, t]) | (m.keys[i, t] < 0)
        n = np.bincount(i[first], m.mult[j[first]], len(m.id)) + np.bincount(j[first], m.mult[i[first]], len(m.id))
        some = np.flatnonzero(n)
        yield pd.DataFrame({"a": m.id[some], "b": pd.array([None] * len(some), "Int64"), "n": n[some].astype(np.int64)}, columns=columns)
        keep = forest(i, j, len(m.id))
        yield pd.DataFrame({"a": m.id[i[keep]], "b": pd.array(m.id[j[keep]], "Int64"), "n": 0}, columns=columns)

    def large(rows: pd.DataFrame):
        """Pairs of one group: within one part of a bucket, or between two."""
        m = Members(rows, int(rows["dim"].iloc[0]), count)
        side, table = rows["part"].to_numpy(), int(rows["t"].iloc[0])
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        for a in range(0, len(left), 256):
            some = left[a : a + 256]
            near = (m.codes[some] @ m.turned[right].T) / np.maximum(m.factor[some], 1e-6)[:, None] + m.bound[some][:, None] >= threshold
            near &= (some[:, None] < right[None, :]) if low == high else True
            i, j = np.nonzero(near)
            i, j = some[i], right[j]
            ok = np.concatenate([np.einsum("ij,ij->i", m.unit[i[b : b + 100_000]], m.unit[j[b : b + 100_000]]) >= threshold for b in range(0, len(i), 100_000)]) if len(i) else np.zeros(0, bool)
            yield from counted(m, i[ok], j[ok], table)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in whole_groups(parts, [*BUCKET, "low_part", "high_part"]):
            for _, some in rows.groupby(group, sort=False):
                yield from large(some.rename(columns={"low_part": "low", "high_part": "high"}).reset_index(drop=True))

    return compare


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    n_links counts the other rows linked directly, component_id is the smallest
    vec_id reachable by links, and kept marks the row that has it. Links are
    pairs with a cosine of the threshold at least in double precision, found in
    buckets of equal sign bits in random rotations: a pair right at the
    threshold is met with probability RECALL, nearer ones more surely, and the
    number of tables follows from that. Within a bucket the codes give unbiased
    estimates of the inner products; only pairs whose upper confidence bound
    reaches the threshold are computed exactly.

    To buckets of at most SMALL members only codes, factors and vectors of four
    bits travel; the few pairs that they leave fetch the vectors. Members of
    larger buckets bring theirs: they are compared in parts, each pair of parts
    in a group of its own, a pair counts in its first common large bucket alone,
    and a bucket leaves only counts and a spanning forest of its links.

    Equal embeddings are one node with a multiplicity. Embeddings that are
    null, empty, zero or have null or non-finite components link with nothing,
    nor do vectors of different lengths. A row whose vec_id is null links with
    nothing and has a null component. Repeated rows are rows of their own.
    """
    prepare(vectors.sparkSession)
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = F.coalesce(valid & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    double = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, double).alias("embedding"))
    keyed = rows.withColumns({"h1": F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")), "h2": F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), "embedding"))})
    nodes = keyed.where("embedding IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding"))
    # The number is written with the node, so it stays whatever is computed again.
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    bits, count = tables(nodes.count(), threshold)

    def codes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, some in part.groupby(part["embedding"].map(len)):
                raw = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                raw = raw / np.abs(raw).max(1)[:, None]
                unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
                code, factor, turned, keys = encode(unit, bits, count)
                query_, low, step = nibbles(turned)
                yield pd.DataFrame({
                    "id": some["id"].to_numpy(), "mult": some["mult"].to_numpy(), "dim": np.int32(dim), "unit": [v.tobytes() for v in unit],
                    "code": [c.tobytes() for c in code], "factor": factor, "query": [c.tobytes() for c in query_], "low": low, "step": step, "buckets": list(keys),
                })

    schema = "id long, mult long, dim int, unit binary, code binary, factor float, query binary, low float, step float, buckets array<int>"
    fat = materialise(nodes.select("id", "mult", "embedding").mapInPandas(codes, schema), "codes")
    thin = fat.select("id", "dim", F.posexplode("buckets").alias("t", "key"))
    full = materialise(thin.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = materialise(thin.join(full, BUCKET), "members")
    # Of a node's buckets the keys of the large ones, by table; -1 where its bucket is not.
    large = met.where(F.col("n") > SMALL).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "key"))).alias("keys"))
    at = F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(F.col("keys")[t].cast("long"), F.lit(0xFFFFFFFF).cast("long"))), 8, "0")) for t in range(count)])
    large = materialise(large.select("id", at.alias("large")), "large")

    light = fat.select("id", "code", "factor", "query", "low", "step")
    few = met.where(F.col("n") <= SMALL).select("id", *BUCKET).join(light, "id").join(large, "id", "left")
    pairs = few.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInPandas(_small(threshold, count), "a long, b long").distinct()
    pairs = materialise(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    whole = by_bitmap(fat.select("id", "unit", "mult"), materialise(bitmap(ends, ["id"]), "ends"), ["id"], True)
    a, b = (whole.select(F.col("id").alias(k), F.col("unit").alias(f"unit_{k}"), F.col("mult").alias(f"mult_{k}")) for k in "ab")
    near = pairs.join(a, "a").join(b, "b").select("a", "b", "unit_a", "unit_b", "mult_a", "mult_b").mapInPandas(_exact(threshold), "a long, b long, mult_a long, mult_b long")
    near = materialise(near, "near")

    size = F.ceil(F.col("n") / PART).cast("int")
    many = met.where(F.col("n") > SMALL).withColumn("parts", size).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("id", *BUCKET, "part", F.least("part", "other").alias("low_part"), F.greatest("part", "other").alias("high_part"))
    many = many.join(fat.select("id", "unit", "mult", "code", "factor"), "id").join(large, "id")
    group = [*BUCKET, "low_part", "high_part"]
    found = many.repartition(*group).sortWithinPartitions(*group).mapInPandas(_large(threshold, count), "a long, b long, n long")
    found = materialise(found, "links")

    sides = near.select("a", F.col("mult_b").alias("n")).union(near.select("b", "mult_a")).union(found.where("b IS NULL").select("a", "n"))
    links = sides.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(near.select("a", "b").union(found.where("b IS NOT NULL").select("a", "b"))).withColumnRenamed("node", "id")
    named = nodes.select("id", "vec_id").join(roots, "id")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "root").select("id", "component_id")
    known = nodes.select("h1", "h2", "id", "mult", "vec_id").join(links, "id", "left").join(named, "id", "left")
    known = known.select("h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = keyed.select("vec_id", "h1", "h2").join(materialise(known, "found"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs, and the smallest vec_id that links reach by a recursive walk: for tables of some thousand vectors.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM u a JOIN u b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(k, to_) AS (SELECT k, k FROM u UNION SELECT r.k, l.b FROM r JOIN l ON r.to_ = l.a),
c AS (SELECT r.k, min(vec_id) AS least FROM r JOIN u ON u.k = r.to_ GROUP BY r.k)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.k) AS n_links, coalesce(c.least, v.vec_id) AS component_id, coalesce(v.vec_id = coalesce(c.least, v.vec_id), false) AS kept
FROM v LEFT JOIN c ON c.k = v.k
"""
