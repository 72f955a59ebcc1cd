"""Random numbers from hashes, equal on every engine and in every run."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

MODULUS = 2147483647


def _key(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hashed(*parts) -> Column:
    """Hexadecimal md5 of the parts, joined by colons."""
    return F.md5(_key(*parts).cast("binary"))


def uniform(*parts) -> Column:
    """A double in [0, 1) from 32 bits of md5."""
    return F.conv(F.substring(hashed(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def dataset_seed(*parts) -> Column:
    """The first four bytes of SHA-256 of the parts, modulo 2**31 - 1."""
    head = F.conv(F.substring(F.sha2(_key(*parts).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return head % MODULUS


def fold_seed(base: Column, repeat: Column, fold: Column, salt: Column) -> Column:
    one = lambda c: c.cast("long")
    return F.pmod(one(base) * 1000003 + one(repeat) * 10007 + one(fold) * 101 + one(salt), F.lit(MODULUS).cast("long"))


# Streams in numpy, for draws that never become rows --------------------------------

#: Odd multipliers of 32 bits: the step of the stream and two of a bijective mix.
STEP, FIRST, SECOND, WORD = 0x9E3779B9, 0x7FEB352D, 0x846CA68B, 0xFFFFFFFF


#: Shifts and constants of md5, and the state that it begins with.
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
#: Numbers that are hashed at once.
PIECE = 1 << 15
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(starts: list[bytes], numbers: np.ndarray, digits: int) -> np.ndarray:
    """first_words() of starts of one length and numbers of so many digits: md5 of one block of 64 bytes for all of them at once."""
    size = len(starts[0]) + digits
    plain = np.frombuffer(b"".join((start + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little") for start in starts), "<u4").reshape(-1, 16)
    message = [plain[:, w : w + 1] for w in range(16)]
    for k in range(digits):
        w, shift = divmod(size - 1 - k, 4)
        rest = numbers // np.uint32(10)
        message[w] = message[w] | (numbers - rest * np.uint32(10) + np.uint32(48)) << np.uint32(8 * shift)
        numbers = rest
    a, b, c, d = (np.array([[v]], np.uint32) for v in BEGIN)
    for i in range(61):  # the first word is final then
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + (message[g] + np.uint32(SINES[i]))
        f += a
        left = f << np.uint32(TURNS[i])
        f >>= np.uint32(32 - TURNS[i])
        f |= left
        f += b
        a, d, c, b = d, c, b, f
    return (b + np.uint32(BEGIN[0])).byteswap()


def first_words(starts: str | list[str], numbers: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of a start and each number in decimals, a row for each of several starts; over 2**32 they are uniform()."""
    if isinstance(starts, str):
        return first_words([starts], numbers)[0]
    numbers, begin = np.asarray(numbers), [x.encode() for x in starts]
    out = np.empty((len(begin), len(numbers)), np.uint32)
    if len(numbers) and (numbers.min() < 0 or numbers.max() > WORD or max(map(len, begin)) > 45):
        for row, x in zip(out, begin):
            row[:] = np.frombuffer(b"".join([hashlib.md5(x + b"%d" % n).digest()[:4] for n in numbers.tolist()]), ">u4")
        return out
    for size in {len(x) for x in begin}:
        alike = [i for i, x in enumerate(begin) if len(x) == size]
        piece = max(1, PIECE // len(alike))
        for at in range(0, len(numbers), piece):
            some = numbers[at : at + piece].astype(np.uint32)
            for n in range(len(str(some.min())), len(str(some.max())) + 1):
                same = np.flatnonzero((some >= (10 ** (n - 1) if n > 1 else 0)) & (some <= min(10**n - 1, WORD)))
                if len(same):
                    out[np.ix_(alike, at + same)] = _words([begin[i] for i in alike], some[same], n)
    return out


def seeds(parts: list[str]) -> np.ndarray:
    """The first 64 bits of the md5 of each text."""
    return np.array([int(hashlib.md5(p.encode()).hexdigest()[:16], 16) for p in parts], np.uint64)


def positions(seed: int, draws: int, size: int) -> np.ndarray:
    """Draws from range(size) with replacement, for a size well under 2**32."""
    seed, word, shift = int(seed), np.uint64(WORD), lambda x, n: x ^ (x >> np.uint64(n))
    x = np.uint64(seed >> 32) + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(STEP) & word
    x = shift(x, 16) * np.uint64(FIRST) & word
    x = shift(x ^ np.uint64(seed & WORD), 15) * np.uint64(SECOND) & word
    return (shift(x, 16) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def seed_sql(text: str) -> str:
    """The two halves of seeds() of a text, as columns _s1 and _s2 of a DuckDB query."""
    return ", ".join(f"CAST('0x' || substr(md5({text}), {at}, 8) AS UBIGINT) AS _s{k}" for k, at in ((1, 1), (2, 9)))


def positions_sql(rows: str, columns: str, j: str, size: str, name: str) -> str:
    """A DuckDB query for columns of rows and, as name, the (j + 1)-th draw of positions() with the seed _s1, _s2."""
    shift = lambda n: f"xor(_x, _x >> {n}::UBIGINT)"
    out = f"SELECT {columns}, {size}::UBIGINT AS _size, _s2, (_s1 + ({j} + 1)::UBIGINT * {STEP}::UBIGINT) & {WORD}::UBIGINT AS _x FROM {rows}"
    for step in (shift(16), f"_x * {FIRST}::UBIGINT & {WORD}::UBIGINT", "xor(_x, _s2)", shift(15), f"_x * {SECOND}::UBIGINT & {WORD}::UBIGINT", shift(16)):
        out = f"SELECT {columns}, _size, _s2, {step} AS _x FROM ({out})"
    return f"SELECT {columns}, CAST(_x * _size >> 32::UBIGINT AS BIGINT) AS {name} FROM ({out})"
