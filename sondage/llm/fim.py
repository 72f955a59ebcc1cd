"""Fill-in-middle transformation of whole batches of texts.

A batch's texts are one UTF-8 buffer, as Arrow holds them. Each byte's class is
looked up, the classes of adjacent bytes say where units begin, sums over the
buffer that start anew with each text number the units, and one search in these
sums finds the cuts of all texts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sondage.llm.common import OWN, packed, prepare, tidy, unpacked

#: Classes of bytes: within a code point, white space but for the line feed, line feed, any other first byte.
INNER, BLANK, FEED, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INNER
CLASS[[9, 11, 12, 13, 32]] = BLANK
CLASS[10] = FEED

#: Of each kind of unit: does one begin between a byte of the first class and one of the second?
BEGINS = {kind: np.zeros((4, 4), bool) for kind in ("line", "word", "char")}
BEGINS["line"][FEED, :] = True
BEGINS["word"][np.ix_([BLANK, FEED], [OTHER])] = True
BEGINS["char"][:, [BLANK, FEED, OTHER]] = True

PLAIN, PSM, SPM = "plain", "psm", "spm"
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel takes at once, but for a text that is longer.
PIECE = 4_000_000


def draws(seed: int, doc_id: str, n: int = 4) -> list[Column]:
    """n numbers below 2**32: 8 hexadecimal digits each of the SHA-256 of `seed:doc_id`; a null doc_id is the text null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The sentinels as bytes; ValueError where one could be found across the end of another or within it."""
    marks = [s.encode() for s in sentinels]
    for a in marks:
        for b in marks:
            if not a or a is not b and a in b or any(b.endswith(a[:k]) for k in range(1, len(a))):
                raise ValueError("sentinels must not be empty, hold each other or begin as one ends")
    return marks


def found(buf: np.ndarray, mark: bytes) -> np.ndarray:
    """Where mark begins in the buffer."""
    at = np.flatnonzero(buf[: max(len(buf) - len(mark) + 1, 0)] == mark[0])
    for k, byte in enumerate(mark[1:], 1):
        at = at[buf[at + k] == byte]
    return at


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and the bounds of its texts in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most limit bytes; a longer text is a run of its own."""
    first = 0
    while first < len(bounds) - 1:
        last = max(int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1, first + 1)
        yield first, last
        first = last


def has_mark(buf: np.ndarray, bounds: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which texts hold one of the marks; one that crosses the end of a text is none."""
    out = np.zeros(len(bounds) - 1, bool)
    for mark in marks:
        at = found(buf, mark)
        text = np.searchsorted(bounds, at, side="right") - 1
        out[text[at + len(mark) <= bounds[text + 1]]] = True
    return out


def cuts(buf: np.ndarray, bounds: np.ndarray, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its units, the ends of prefix and middle as places in the buffer, and the code points of both."""
    starts, ends, full = bounds[:-1], bounds[1:], bounds[:-1] < bounds[1:]
    kind = CLASS[buf]
    new = np.zeros(len(buf), bool)
    new[1:] = begins[kind[:-1], kind[1:]]
    new[starts[full]] = True  # whatever the byte before, which is another text's
    upto = np.concatenate(([0], np.cumsum(new, dtype=np.int64)))
    before = upto[starts]
    n = upto[ends] - before
    drawn = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # Unit k of a text begins where the sum first reaches before + k + 1; the unit after a text's last is another's.
    at = np.minimum(np.searchsorted(upto, before[:, None] + drawn + 1, side="left") - 1, ends[:, None])
    points = np.concatenate(([0], np.cumsum(kind != INNER, dtype=np.int64)))
    return n, at[:, 0], at[:, 1], points[at[:, 0]] - points[starts], points[at[:, 1]] - points[at[:, 0]]


def transformed(texts: pa.Array, h: np.ndarray, marks: list[bytes], begins: np.ndarray, rate: int, spm_rate: int, piece_bytes: int) -> pa.StructArray:
    """(n, form, prefix_chars, middle_chars, output) of each text, from its four drawn numbers."""
    whole, offsets = buffer(texts)
    p, s, m = marks
    cols: list[list] = [[], [], [], [], []]
    for first, last in pieces(offsets, piece_bytes):
        bounds = offsets[first : last + 1] - offsets[first]
        buf = whole[offsets[first] : offsets[last]]
        own = h[first:last]
        n, one, two, prefix, middle = cuts(buf, bounds, own, begins)
        plain = (bounds[:-1] == bounds[1:]) | has_mark(buf, bounds, marks) | (own[:, 2] % 100 >= rate)
        form = np.where(plain, PLAIN, np.where(own[:, 3] % 100 < spm_rate, SPM, PSM))
        data, out = memoryview(buf), []
        for f, a, b, c, d in zip(form.tolist(), bounds[:-1].tolist(), one.tolist(), two.tolist(), bounds[1:].tolist()):
            if f == PLAIN:
                out.append(bytes(data[a:d]))
            else:
                order = (s, data[c:d], p, data[a:b]) if f == SPM else (p, data[a:b], s, data[c:d])
                out.append(b"".join((*order, m, data[b:c])))
        for col, part in zip(cols, (pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).view(pa.string()))):
            col.append(part)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.StructArray.from_arrays([pa.concat_arrays(c) if c else pa.array([], k) for c, k in zip(cols, kinds)], RESULT_NAMES)


RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
RESULT_NAMES = ["n", "form", "prefix_chars", "middle_chars", "output"]


def rebuilt(outputs: pa.Array, forms: pa.Array, marks: list[bytes], piece_bytes: int) -> pa.Array:
    """The texts that outputs of the forms were made of; ValueError for an output that is not of its form."""
    whole, offsets = buffer(outputs)
    p, s, m = map(len, marks)
    done: list[pa.Array] = []
    for first, last in pieces(offsets, piece_bytes):
        bounds, buf = offsets[first : last + 1] - offsets[first], whole[offsets[first] : offsets[last]]
        form = np.array(forms.slice(first, last - first).to_pylist(), object)
        cut = form != PLAIN
        places = []
        for mark in marks:
            at = found(buf, mark)
            text = np.searchsorted(bounds, at, side="right") - 1
            ok = cut[text] & (at + len(mark) <= bounds[text + 1])
            place = np.full(last - first, -1)
            place[text[ok][::-1]] = at[ok][::-1]  # the first in each text
            places.append(place)
        ap, as_, am = places
        spm = form == SPM
        head, then = np.where(spm, as_, ap), np.where(spm, ap, as_)
        if (cut & ((head != bounds[:-1]) | (then <= head) | (am <= then))).any():
            raise ValueError("an output is not of its form")
        data, out = memoryview(buf), []
        rows = zip(form.tolist(), bounds[:-1].tolist(), ap.tolist(), as_.tolist(), am.tolist(), bounds[1:].tolist())
        for f, a, x, y, z, d in rows:
            if f == PLAIN:
                out.append(bytes(data[a:d]))
            else:
                prefix, suffix = (data[x + p : z], data[y + s : x]) if f == SPM else (data[x + p : y], data[y + s : z])
                out.append(b"".join((prefix, data[z + m : d], suffix)))
        done.append(pa.array(out, pa.binary()).view(pa.string()))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def fill_in_middle(docs: DataFrame, *, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, piece_bytes: int = PIECE) -> DataFrame:
    """docs (doc_id, text) with n, form, prefix_chars, middle_chars and output.

    A text is cut between its units (`line`, `word` or `char`): prefix, middle
    and suffix are whole units, as two numbers drawn from the hash of doc_id
    say. Of 100 texts `rate` are cut, and of these `spm_rate` have the suffix
    first (spm), the others the prefix (psm). n counts units, the other counts
    are code points.

    Empty and null texts and those that hold a sentinel are plain: output is the
    text (null: empty), the code points are null. A null doc_id is hashed as the
    text `null`; repeated rows come out alike. Any length is transformed whole.
    Without rows there are no rows. All other columns stay; a result whose name
    docs has already gets underscores behind it.
    """
    spark = docs.sparkSession
    prepare(spark)
    marks, begins = checked(sentinels), BEGINS[unit]
    rows = packed(docs, _text=F.col("text").cast("string"), **{f"_h{k}": h for k, h in enumerate(draws(seed, "doc_id"))})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.stack([b.column(f"_h{k}").to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(OWN), transformed(b.column("_text"), h, marks, begins, rate, spm_rate, piece_bytes)], [OWN, "_r"])

    made = rows.mapInArrow(run, f"{OWN} {rows.schema[OWN].dataType.simpleString()}, _r struct<{_typed(RESULT)}>")
    return unpacked(made, docs, **{name: F.col(f"_r.{name}") for name in RESULT_NAMES})


def _typed(ddl: str) -> str:
    return ", ".join(":".join(f.split(" ")) for f in ddl.split(", "))


def restore(rows: DataFrame, output: str = "output", form: str = "form", *, name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS, piece_bytes: int = PIECE) -> DataFrame:
    """rows with the text that each output was made of, exactly; a null output is empty, a null form is plain."""
    spark = rows.sparkSession
    prepare(spark)
    marks = checked(sentinels)
    whole = packed(rows, _output=F.col(output), _form=F.coalesce(F.col(form), F.lit(PLAIN)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(OWN), rebuilt(b.column("_output"), b.column("_form"), marks, piece_bytes)], [OWN, "_r"])

    made = whole.mapInArrow(run, f"{OWN} {whole.schema[OWN].dataType.simpleString()}, _r string")
    return unpacked(made, rows, **{name: F.col("_r")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = restore(fill_in_middle(docs).drop("text"))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS s FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
