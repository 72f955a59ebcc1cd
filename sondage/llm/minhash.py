"""Near-duplicate documents by ProbMinHash sketches of weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import Fingerprints, SPACE, bitmap, by_bitmap, chunks, forest, joined, materialise, mix, node_key, node_number, packed, prepare, runs, tidy, unpacked, whole_groups
from sondage.operators.graph import components

WORDS, THRESHOLD = 5, 0.8
#: Registers of a sketch: BANDS bands of ROWS; a pair at the threshold shares no band with probability (1 - 0.8**4)**20 < 3e-5.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: How far under the threshold an estimate may lie before a pair is not verified: over four deviations.
SLACK = 0.2
#: Members of a bucket's part, and the columns of a group of pairs.
PART = 512
GROUP = ["key", "low", "high"]
MEMBER = ["key", "node", "root", "part", "low", "high"]
#: Bytes of text that are sketched at once: the turns of a sketch cost alike for few texts and many.
SKETCHED = 2_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(rows: list[bytes], prints: Fingerprints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, count) of the distinct shingles, by row and fingerprint.

    A shingle is WORDS consecutive words, parted by ASCII white space, A-Z in
    lower case; a text with fewer words, but some, has one of them all.
    """
    buf, starts, _ = joined(rows, b"\n")
    ws, we = runs(~SPACE[buf])
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = prints.load(LOWER[buf]).of(ws, we)
    row = np.searchsorted(starts, ws, side="right") - 1
    n = np.bincount(row, minlength=len(rows))
    first = np.concatenate(([0], np.cumsum(n)))
    # Padding words stand after each short text's own.
    word = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    at = np.concatenate((np.flatnonzero(np.arange(len(ws)) + WORDS <= first[row + 1]), first[:-1][(n > 0) & (n < WORDS)]))
    of = row[at]
    total = np.full(len(at), 0x632BE59BD9B4E019, np.uint64)
    for k in range(WORDS):
        there = at + k < first[of + 1]
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + np.where(there, word[at + k], np.uint64(1)))
    order = np.lexsort((total, of))
    of, total = of[order], total[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (total[1:] != total[:-1])
    where = np.flatnonzero(new)
    return of[where], total[where], np.diff(np.append(where, len(of)))


def each(texts, prints: Fingerprints) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingles and counts of each text, from a bounded number of bytes at once."""
    out = []
    for _, rows in chunks(texts):
        row, item, count = shingles(rows, prints)
        at = np.searchsorted(row, np.arange(len(rows) + 1))
        out += [(item[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:])]
    return out


def sketches(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash: (registers, which of the n rows have items). A register holds the item that arrives in it first.

    Each item's arrivals are a Poisson process whose rate is its weight, every
    arrival in a random register; times and registers come from the item's hash
    alone. All items take their next arrival in turn, and an item ends as soon
    as its arrival is later than the last first arrival of its row, so after the
    first turn only few go on. Two rows' registers agree with a probability
    equal to their probability Jaccard similarity.
    """
    best = np.full(n * REGISTERS, np.inf)
    held = np.zeros(n * REGISTERS, np.uint64)
    filled = np.zeros(n, bool)
    filled[row] = True
    time, turn = np.zeros(len(row)), 0
    while len(row):
        turn += 1
        draw = mix(item + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        slot = row * REGISTERS + ((draw >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        uniform = ((mix(draw) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        early = np.flatnonzero(time < best[slot])
        np.minimum.at(best, slot[early], time[early])
        won = early[time[early] == best[slot[early]]]
        held[slot[won]] = item[won]
        rows, back = np.unique(row, return_inverse=True) if turn > 2 else (None, row)
        last = best.reshape(n, REGISTERS)[rows if rows is not None else slice(None)].max(1)
        go = time < last[back]
        row, item, weight, time = row[go], item[go], weight[go], time[go]
    return held.reshape(n, REGISTERS), filled


def bands(registers: np.ndarray) -> np.ndarray:
    """A key for each band, different between bands."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    total = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total.view(np.int64)


def weights(count: np.ndarray) -> np.ndarray:
    """A shingle's weight grows with the logarithm of its count, so that one line repeated hundreds of times does not make a text."""
    return 1 + np.log(count)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The larger of two similarities of items a with counts x and b with counts y; items sorted and distinct.

    The probability Jaccard similarity of the weights u and v is the sum over
    common items d of 1 / sum over all j of max(u[j] / u[d], v[j] / v[d]). The
    Jaccard similarity of the items is the same where no item repeats.
    """
    at = np.searchsorted(a, b)
    common = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == b) if len(a) else np.zeros(0, int)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a) + len(b) - len(common))
    if x.max() == 1 and y.max() == 1:
        return plain
    u, v, mine = weights(x), weights(y), at[common]
    left, right = u[mine], v[common]
    only_u, only_v = float(u.sum() - left.sum()), float(v.sum() - right.sum())
    ratio = left / right
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate(([0.0], np.cumsum(right[order])))  # of v, where u / v is smaller
    above = np.concatenate((np.cumsum(left[order][::-1])[::-1], [0.0]))  # of u, where it is not
    k = np.searchsorted(ratio[order], ratio)
    return max(plain, float((left / (only_u + above[k] + ratio * (only_v + below[k]))).sum()))


def both_sketches(row: np.ndarray, item: np.ndarray, count: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(registers of each row, which of the n rows have items): REGISTERS of the weighted items, then as many of the items
    with equal weights, whose agreement estimates the Jaccard similarity. Where no item repeats both are the same and stand once."""
    many = np.unique(row[count > 1])
    again = np.isin(row, many)
    rows = np.concatenate((row, n + np.searchsorted(many, row[again])))
    held, filled = sketches(rows, np.concatenate((item, item[again])), np.concatenate((weights(count), np.ones(int(again.sum())))), n + len(many))
    out = list(held[:n])
    for k, r in enumerate(many):
        out[r] = np.concatenate((held[r], held[n + k]))
    return out, filled[:n]


def _sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    prints = Fingerprints()
    for part in parts:
        for first, rows in chunks(part["text"].tolist(), SKETCHED):
            some = part.iloc[first : first + len(rows)]
            row, item, count = shingles(rows, prints)
            held, filled = both_sketches(row, item, count, len(rows))
            of = np.repeat(np.arange(len(rows)), [len(h) // REGISTERS for h in held])
            keys = np.split(bands(np.concatenate(held).reshape(-1, REGISTERS)), np.searchsorted(of, np.arange(1, len(rows))))
            yield pd.DataFrame({
                "doc_id": some["doc_id"].to_numpy(), "h1": some["h1"].to_numpy(), "h2": some["h2"].to_numpy(),
                "bands": [k.reshape(-1) if f else None for k, f in zip(keys, filled)],
                "sketch": [h.astype(np.uint16).tobytes() for h in held],
            })


def _verify(threshold: float):
    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints()
        for part in parts:
            # A leader's pairs mostly stand together; its shingles are made once.
            keep, lead, held = np.zeros(len(part), bool), None, None
            for a in range(0, len(part), 256):
                some = part.iloc[a : a + 256]
                for k, (left, text, node) in enumerate(zip(each(some["text_a"], prints), some["text_b"], some["b"]), a):
                    if node != lead:
                        lead, held = node, each([text], prints)[0]
                    keep[k] = similarity(*left, *held) >= threshold
            yield part.loc[keep, ["a", "b"]]

    return verify


def _near(rows: pd.DataFrame, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of one part of a bucket: each member, and those of other components that its registers do not rule out."""
    # Of the weighted and of the plain items; a text whose items do not repeat has them once.
    sketch = np.stack([np.resize(np.frombuffer(s, np.uint16), (2, REGISTERS)) for s in rows["sketch"]])
    keys = np.stack([np.resize(k, (2, BANDS)) for k in rows["bands"]])
    at_band = int(np.flatnonzero(keys[0] == rows["key"].iloc[0])[0]) % BANDS
    root = pd.factorize(rows["root"])[0]
    side, low, high = rows["part"].to_numpy(), rows["low"].iloc[0], rows["high"].iloc[0]
    for i in np.flatnonzero(side == low):
        others = np.flatnonzero((side == high) & (root != root[i]))
        others = others[others > i] if low == high else others
        near = others[(sketch[others] == sketch[i]).mean(2).max(1) >= threshold - SLACK]
        # A pair that shares an earlier bucket is compared there, whichever sketches brought it in.
        mine, theirs = keys[i, :, :at_band], keys[near, :, :at_band]
        yield i, near[~((theirs == mine) | (theirs == mine[::-1])).any((1, 2))]


def _open(threshold: float):
    """The rows whose text some pair of their part still needs."""

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in whole_groups(parts, GROUP):
            for _, some in rows.groupby(group, sort=False):
                some, asked = some.reset_index(drop=True), np.zeros(len(some), bool)
                for i, near in _near(some, threshold):
                    asked[i] |= len(near) > 0
                    asked[near] = True
                yield some.loc[asked, MEMBER]

    return compare


def _rest(threshold: float):
    def large(rows: pd.DataFrame, prints: Fingerprints):
        """Links between members of one group that are in different components."""
        own = each(rows["text"], prints)
        i_found, j_found = [], []
        for i, near in _near(rows, threshold):
            for j in near:
                if similarity(*own[i], *own[j]) >= threshold:
                    i_found.append(i)
                    j_found.append(j)
        i, j = np.array(i_found, int), np.array(j_found, int)
        keep = forest(i, j, len(rows))
        node = rows["node"].to_numpy()
        return pd.DataFrame({"a": node[i[keep]], "b": node[j[keep]]})

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints()
        for rows, group in whole_groups(parts, GROUP):
            for _, some in rows.groupby(group, sort=False):
                yield large(some.reset_index(drop=True), prints)

    return compare


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept, h1, h2) for each row of docs (doc_id, text).

    Documents whose weighted shingles have a probability Jaccard similarity, or
    whose shingles a Jaccard similarity, of the threshold at least are linked; class_id is the smallest doc_id that a
    document reaches by links, and kept marks the document that has it
    (of several texts with that doc_id the one whose node key is smallest).

    1. Equal texts become one node (h1 and h2 hash the text), and each node's
       ProbMinHash registers give its band keys: those of the weighted shingles
       and, where a shingle repeats, those of the shingles alone as well, so
       that both similarities bring their pairs together.
    2. In every bucket of a band the member that meets most others leads; each
       member is verified with its leaders on the whole texts. So a group of
       any size has as many pairs as members, and copies of one original meet
       it rather than each other.
    3. Where a bucket still holds several components, its members in different
       ones are compared with each other, by registers first and, where these
       leave something, exactly, in parts of bounded size of which only a spanning forest of the links is
       passed on. With it no link between members of a bucket is lost.

    Null texts and rows with a null doc_id are in no class (null text: a class
    of its own; null doc_id: class_id is null, kept is true). Texts without
    words are near only to equal texts. Rows with the same doc_id and text are
    in one class and all marked kept; extra columns are ignored; without rows
    there are no rows.
    """
    prepare(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = plain.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}).where("doc_id IS NOT NULL AND text IS NOT NULL")
    every = plain.select("doc_id", "h1", "h2", "text").mapInPandas(tidy(_sketch), "doc_id long, h1 long, h2 long, bands array<long>, sketch binary")
    nodes = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes.withColumn("node", node_key("doc_id", "h1", "h2")), "nodes")

    keyed = nodes.where("bands IS NOT NULL").select("node", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = materialise(keyed.join(buckets, "key"), "met")
    mates = met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("mates"))
    leads = met.join(mates, "node").groupBy("key").agg(F.max(F.struct("mates", "node")).alias("top"))
    leads = materialise(leads.select("key", F.col("top.node").alias("lead")), "leads")
    pairs = met.join(leads, "key").where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")

    # The texts of the nodes that meet others, one row each, and a few more that share a bit with one of them.
    own = plain.withColumn("node", node_key("doc_id", "h1", "h2"))
    texts = materialise(by_bitmap(own, bitmap(met, ["node"]), ["node"], True).groupBy("node").agg(F.first("text").alias("text")), "texts")
    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    links = materialise(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(tidy(_verify(threshold)), "a binary, b binary"), "links")

    roots = materialise(components(links), "roots")
    open_ = met.where("n > 2").join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = open_.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    size = F.ceil(F.col("n") / PART).cast("int")
    rest = open_.join(materialise(mixed, "mixed"), "key").withColumn("parts", size).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("key", "node", "root", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    # First by registers alone; texts travel only to the members that this leaves.
    parted = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP)
    sketched = nodes.select("node", "sketch", "bands")
    rest = parted(materialise(rest, "rest").join(sketched, "node")).mapInPandas(tidy(_open(threshold)), "key long, node binary, root binary, part int, low int, high int")
    rest = materialise(rest, "open").join(sketched, "node").join(texts, "node")
    more = parted(rest).mapInPandas(tidy(_rest(threshold)), "a binary, b binary")
    more = materialise(more, "more")

    roots = components(links.unionByName(more))
    named = nodes.join(roots, "node", "left").select("h1", "h2", F.coalesce(node_number("root"), node_number("node")).alias("class_id"), (F.coalesce("root", "node") == F.col("node")).alias("top"))
    classes = materialise(named, "classes").select("h1", "h2", "class_id", "top")
    known = plain.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id", (F.col("top") & (F.col("doc_id") == F.col("class_id"))).alias("kept"), "h1", "h2")
    alone = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NULL OR text IS NULL")
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return known.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each class; rules as in near_duplicates().

    Rows that repeat a kept document's doc_id and text go as well; documents
    with a null doc_id or text stay. All columns stay, whatever their names.
    """
    found = materialise(near_duplicates(docs, **options).where("doc_id IS NOT NULL"), "classes")
    keys = ["id", "h1", "h2"]
    gone = found.where("NOT kept").select(F.col("doc_id").alias("id"), "h1", "h2").distinct()
    text = F.col("text")
    hashed = packed(docs, id=F.col("doc_id").cast("long"), h1=F.xxhash64(text), h2=F.xxhash64(F.lit(1), text), empty=text.isNull())
    gone = materialise(gone, "gone")
    bits = materialise(bitmap(gone, keys), "bits")
    # Only documents that may go are shuffled.
    out = by_bitmap(hashed, bits, keys, True).join(gone, keys, "left_anti").unionByName(by_bitmap(hashed, bits, keys, False))
    again = found.where("kept").groupBy("doc_id", "h1", "h2").count().where("count > 1").limit(1).count()
    if again:
        named = out.where("id IS NOT NULL AND NOT empty").dropDuplicates(keys)
        out = named.unionByName(out.where("id IS NULL OR empty"))
    return unpacked(out, docs)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "kept")
