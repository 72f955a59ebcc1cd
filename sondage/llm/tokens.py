"""Token counts of a unigram tokenizer by a count-only Viterbi search over Aho-Corasick matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import Fingerprints, Residues, chunks, joined, packed, prepare, unpacked

#: The mark that stands for a space, and what an unknown character costs beside the lowest score.
MARK = "▁"
MARK_BYTES = MARK.encode()
UNKNOWN_COST = 10.0
#: Entries of the memo of a task's words, of which the older half goes when it is full; bytes of text that are counted at once.
MEMO, BATCH = 400_000, 1_500_000
#: Characters of a part that is searched beside others, and how many of these at once.
SHORT, AT_ONCE = 64, 20_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; byte_fallback spells unknown characters in bytes; prefix puts a mark before a text."""

    scores: dict[str, float]
    lowest: float
    byte_fallback: bool = True
    prefix: bool = True


def load(model_file: str) -> Vocabulary:
    """The normal pieces of a tokenizer file, with their scores read as unigram scores.

    A file whose own algorithm is another (merges of pairs) counts here as a
    unigram model with those scores: counts are exact for that model, and not
    those of the file's own algorithm.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
    scores = {p.id_to_piece(i): float(p.get_score(i)) for i in ids}
    return Vocabulary(scores, min(scores.values()), sum(p.is_byte(i) for i in range(p.get_piece_size())) == 256)


class Counter(dict):
    """Best score and piece count of a text's parts.

    A text is cut where no piece can span the cut: before a mark that follows
    another character, and around line ends, if the vocabulary allows. Within a
    part the automaton lists the pieces that end at each character, and the
    search keeps the best score and its count alone. The tokenizer's rules for
    ties hold: starts are tried in order and a later one must be strictly
    better, so of equal paths that with the longest last piece stays; a
    character is unknown only where no piece of one character matches.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.unknown = vocabulary.lowest - UNKNOWN_COST
        self.machine = ahocorasick.Automaton()
        self.sizes, self.scores = np.array([len(p) for p in vocabulary.scores] or [0]), np.array([*vocabulary.scores.values()] or [0.0])
        self.pieces = list(zip(self.sizes.tolist(), self.scores.tolist()))
        for k, piece in enumerate(vocabulary.scores):
            self.machine.add_word(piece, k)
        self.machine.make_automaton()
        self.single = {p for p in vocabulary.scores if len(p) == 1}
        long = [p for p in vocabulary.scores if len(p) > 1]
        marks = not any(MARK in p.lstrip(MARK) for p in long)
        lines = not any("\n" in p for p in long)
        stop = "\n" if lines else ""
        body = f"{MARK}*[^{MARK}{stop}]+|{MARK}+" if marks else f"[^{stop}]+" if lines else r"[\s\S]+"
        self.parts = re.compile(body + ("|\n" if lines else "")).findall
        #: Whether parts end where bytes say so, before a mark and around a line end.
        self.by_bytes = marks and lines
        self.prints, self.residues = Fingerprints(), Residues()
        self.known: dict[int, tuple[int, float, int]] = {}

    def __missing__(self, part: str) -> tuple[float, int]:
        found = self.search(part)
        if len(self) >= MEMO:
            self.clear()
        if len(part) <= 64:
            self[part] = found
        return found

    def batch(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, scores) of texts in UTF-8. Each distinct part of all of them is searched once: parts are told apart by
        fingerprints of 95 bits, and looked up by these when another batch has them too."""
        if not self.by_bytes:
            return self.batch_apart(rows)
        lead = MARK_BYTES if self.vocabulary.prefix else b""
        buf, first, last = joined([lead + r.replace(b" ", MARK_BYTES) if r else r for r in rows])
        mark = np.zeros(len(buf) + 3, bool)
        mark[: len(buf)] = buf == MARK_BYTES[0]
        for k in (1, 2):
            mark[: max(len(buf) - k, 0)] &= buf[k:] == MARK_BYTES[k]
            mark[max(len(buf) - k, 0) : len(buf)] = False
        begins = mark[: len(buf)].copy()
        begins[3:] &= ~mark[: max(len(buf) - 3, 0)]
        line = buf == 10
        begins |= line
        begins[1:] |= line[:-1]
        full = first < last
        begins[first[full]] = True
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(len(rows), np.int64), np.zeros(len(rows))
        end = np.append(start[1:], len(buf))
        prints, residues = self.prints.load(buf).of(start, end), self.residues.load(buf).of(start, end)
        words, at, number = np.unique(prints, return_index=True, return_inverse=True)
        if (residues[at][number] != residues).any():  # two parts with one fingerprint
            return self.batch_apart(rows)
        raw, score, count, new = buf.tobytes(), np.empty(len(words)), np.empty(len(words), np.int64), []
        for k, (w, r, a, b) in enumerate(zip(words.tolist(), residues[at].tolist(), start[at].tolist(), end[at].tolist())):
            held = self.known.get(w)
            if held is not None and held[0] == r:
                score[k], count[k] = held[1], held[2]
                continue
            part = raw[a:b].decode("utf-8", "surrogatepass")
            if len(part) > SHORT:
                score[k], count[k] = self.search(part)
            else:
                new.append((k, w, r, part))
        for a in range(0, len(new), AT_ONCE):
            some = new[a : a + AT_ONCE]
            for (k, w, r, _), (s, n) in zip(some, self.search_many([p for *_, p in some])):
                score[k], count[k] = s, n
                self.known[w] = (r, s, n)
        if len(self.known) > MEMO:
            for w in list(self.known)[: len(self.known) // 2]:
                del self.known[w]
        sums = lambda of: np.add.reduceat(of[number], np.searchsorted(start, first[full]))
        n, s = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        n[full], s[full] = sums(count), sums(score)
        return n, s

    def batch_apart(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same, text by text."""
        found = [self.text(r.decode("utf-8", "surrogatepass")) for r in rows]
        return np.array([n for _, n in found], np.int64), np.array([s for s, _ in found], float)

    def search(self, part: str) -> tuple[float, int]:
        best, count, done = [0.0], [0], 0
        vocabulary, single = self.vocabulary, self.single
        matches: list[tuple[int, float]] = []

        def settle(end: int) -> None:
            """Settle all ends up to this one; matches are those that end there."""
            for e in range(len(best), end + 1):
                top, pieces, start = -np.inf, 0, -1
                for size, score in matches if e == end else ():
                    total = best[e - size] + score
                    if total > top or (total == top and e - size < start):
                        top, pieces, start = total, count[e - size] + 1, e - size
                if part[e - 1] not in single:
                    total = best[e - 1] + self.unknown
                    if total > top:
                        top, pieces = total, count[e - 1] + (len(part[e - 1].encode("utf-8", "surrogatepass")) if vocabulary.byte_fallback else 1)
                best.append(top)
                count.append(pieces)

        for at, match in self.machine.iter(part):
            if at + 1 != done:
                if done:
                    settle(done)
                matches.clear()
                done = at + 1
            matches.append(self.pieces[match])
        if done:
            settle(done)
        matches.clear()
        settle(len(part))
        return best[-1], count[-1]

    def search_many(self, parts: list[str]) -> list[tuple[float, int]]:
        """search() of each part, none of them long, side by side: one pass of the automaton over all, then the ends at the
        first character of every part, at the second, and so on."""
        text = "\n".join(parts) + "\n"  # no longer piece has a line end
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        of = np.repeat(np.arange(len(parts)), size + 1)
        found = np.fromiter(chain.from_iterable(self.machine.iter(text)), np.int64).reshape(-1, 2)
        gap = np.zeros(len(text), bool)
        gap[first + size] = True
        found = found[~gap[found[:, 0]]]
        end, length, gain = found[:, 0] + 1, self.sizes[found[:, 1]], self.scores[found[:, 1]]
        lone = ~gap
        lone[found[length == 1, 0]] = False
        odd = np.flatnonzero(lone) + 1  # ends of characters that are no piece
        spelled = np.array([len(text[e - 1].encode("utf-8", "surrogatepass")) for e in odd.tolist()] if self.vocabulary.byte_fallback else [1] * len(odd), np.int64)
        best, count, came = np.full(len(text) + 1, -np.inf), np.zeros(len(text) + 1, np.int64), np.full(len(text) + 1, len(text))
        best[first] = 0.0
        depth, odd_depth = end - first[of[end - 1]], odd - first[of[odd - 1]]
        by, odd_by = np.argsort(depth, kind="stable"), np.argsort(odd_depth, kind="stable")
        most = int(size.max(initial=0))
        cut, odd_cut = np.searchsorted(depth[by], np.arange(1, most + 2)), np.searchsorted(odd_depth[odd_by], np.arange(1, most + 2))
        for d in range(most):
            m = by[cut[d] : cut[d + 1]]
            e, start = end[m], end[m] - length[m]
            total = best[start] + gain[m]
            np.maximum.at(best, e, total)
            top = np.flatnonzero(total == best[e])
            np.minimum.at(came, e[top], start[top])
            count[e[top]] = count[came[e[top]]] + 1
            u = odd_by[odd_cut[d] : odd_cut[d + 1]]
            e, total = odd[u], best[odd[u] - 1] + self.unknown
            over = total > best[e]
            best[e[over]], count[e[over]] = total[over], count[e[over] - 1] + spelled[u[over]]
        return list(zip(best[first + size].tolist(), count[first + size].tolist()))

    def text(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = text.replace(" ", MARK)
        score, n = 0.0, 0
        for part in self.parts(MARK + text if self.vocabulary.prefix else text):
            s, k = self[part]
            score += s
            n += k
        return score, n


def count_udf(vocabulary):
    @F.pandas_udf("n_tokens long, score double")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(vocabulary.value)
        for texts in parts:
            found = [counter.batch(rows) for _, rows in chunks(texts.tolist(), BATCH)]
            n, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
            yield pd.DataFrame({"n_tokens": n, "score": score})

    return count


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with n_tokens and score (of the best path) of each whole text.

    All columns of docs stay (a result whose name is taken gets an underscore
    behind it). Null and empty texts have no tokens and score 0;
    without byte pieces an unknown character counts as one token. Repeated rows
    count alike. The vocabulary, whose size the tokenizer file fixes, is the
    only thing that is sent to the executors.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = packed(docs, text=F.col("text")).withColumn("found", count_udf(sent)("text"))
    return unpacked(out, docs, n_tokens=F.col("found.n_tokens"), score=F.col("found.score"))


#: The vocabulary file that the query reads.
QUERY_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def query(spark, sf_dir: str, model_file: str = QUERY_MODEL) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, load(model_file)).select("doc_id", "n_tokens", "score")
