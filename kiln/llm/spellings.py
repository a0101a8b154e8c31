"""Grouping spelling variants: PartEnum signatures of letter multisets.

A word's letters are a multiset, seen as a binary vector over (letter, how many-th); one replaced letter changes
two of its bits, an inserted or deleted one changes one.  So words one edit apart are at a Hamming distance of at
most ``DISTANCE``.  The letters are dealt to ``FIRST`` x ``SECOND`` parts; by the pigeonhole principle two near words
differ by at most ``DISTANCE`` // ``FIRST`` bits in one of the first-level parts, and so agree exactly on all but that
many of its second-level parts.  Each choice of these is one signature; words with equal signatures meet, and pairs
are verified as texts, so the result is exact.  A pair is reported by the first signature that it shares.

A group of more than ``GROUP`` words (few letters left in the signature) is not paired: its words go on to a second
round with a narrower key as well, the first or last half of the text (one edit leaves one of them whole), and what is
still too large to a third: the text left when a letter goes.  Few words share such a text, whatever the group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.scratch import tidy, written
from kiln.llm.words import _Powers, mix

DISTANCE = 2
FIRST, SECOND = 1, 6
GROUP = 512
LENGTH, SEEN, TIMES, NOISE = 7, 2, 10, 31
#: Candidate pairs, and code points of pairs, that are looked at together.
_PAIRS, _CHARS = 1 << 20, 1 << 21

_U = np.uint64
_POWERS = _Powers(0x2545F4914F6CDD1D)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, noise: int | None = NOISE) -> DataFrame:
    """(word): every run of letters (A-Z, a-z, U+00C0 to U+00FF) of the whole texts, A-Z lower-cased, that has at
    least ``length`` code points in the end.  Where ``noise`` divides the CRC of ``<id>:<run>``, the run's code point
    number CRC modulo its length goes first (None: never).  Null texts have no words; a null id counts as empty."""
    runs = F.expr(f"regexp_extract_all(translate(`{text_col}`, '{_UPPER}', '{_LOWER}'), '[a-z\\\\u00C0-\\\\u00FF]{{{length},}}', 0)")
    if noise is None:
        return docs.select(F.explode(runs).alias("word"))
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    words = words.select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return words.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)


class Scheme:
    """Which parts of a word's letters each signature keeps."""

    def __init__(self, distance: int = DISTANCE, first: int = FIRST, second: int = SECOND):
        gone = distance // first  # bits that may differ in the best first-level part
        if second <= gone:
            raise ValueError(f"{second} second-level parts cannot leave out {gone}")
        self.distance, self.parts = distance, first * second
        self.kept = [k for g in range(first) for k in combinations(range(g * second, (g + 1) * second), second - gone)]
        # of the parts that differ (as bits), the first signature that does not look at them; one past the end: none
        self.earliest = np.array([next((i for i, k in enumerate(self.kept) if not any(m >> p & 1 for p in k)), len(self.kept)) for m in range(1 << self.parts)])

    def of_parts(self, chars: np.ndarray, start: np.ndarray) -> np.ndarray:
        """A hash of the multiset of letters in each part of each word (words x parts); no word is empty."""
        value, part = mix(chars.astype(np.uint64), 3), chars % self.parts
        return np.stack([np.add.reduceat(np.where(part == p, value, _U(0)), start) for p in range(self.parts)], 1)

    def signatures(self, parts: np.ndarray) -> np.ndarray:
        """(words x signatures)"""
        salted = np.stack([mix(parts[:, p], p + 10) for p in range(self.parts)], 1)
        return np.stack([mix(salted[:, list(k)].sum(1), i + 100) for i, k in enumerate(self.kept)], 1)


def _chars(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words, and where each starts and how long it is."""
    length = np.asarray(pc.utf8_length(words), dtype=np.int64)
    chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return chars, np.cumsum(length) - length, length


class _Halves:
    """Hashes of the first and the last half of each word, at its own length and without its middle letter's place
    (that of a word one shorter): one edit leaves one of them as it is."""

    def __init__(self, chars: np.ndarray, start: np.ndarray, length: np.ndarray):
        up, down = _POWERS.upto(len(chars) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(chars.astype(np.uint64), 5) * up[: len(chars)])])
        part = lambda lo, hi: (run[hi] - run[lo]) * down[lo]
        end = start + length
        self.first = [part(start, start + n // 2) for n in (length, length - 1)]
        self.last = [part(end - (n - n // 2), end) for n in (length, length - 1)]

    def agree(self, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Whether a half is the same; ``more``: how many letters b has more than a."""
        same = (self.first[0][a] == np.where(more > 0, self.first[1][b], self.first[0][b])) | (self.last[0][a] == np.where(more > 0, self.last[1][b], self.last[0][b]))
        return same


def _one_edit(chars, start, length, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, different, b as long or one longer, differ by one edit: what they share at the front
    and at the back leaves no more than one code point."""
    out, lo = np.zeros(len(a), bool), 0
    order = np.argsort(length[b], kind="stable")
    longest = length[b][order]
    while lo < len(order):  # up to twice the first pair's length, and at most _CHARS code points
        hi = int(np.searchsorted(longest, 2 * longest[lo], "right"))
        hi = min(hi, lo + max(1, _CHARS // (2 * int(longest[lo]))))
        x, y = a[order[lo:hi]], b[order[lo:hi]]
        n, width = length[x], np.arange(length[x].max())
        within, i = width < n[:, None], np.minimum(width, n[:, None] - 1)
        front = (chars[start[x][:, None] + i] == chars[start[y][:, None] + i]) & within
        back = (chars[(start[x] + n - 1)[:, None] - i] == chars[(start[y] + length[y] - 1)[:, None] - i]) & within
        shared = np.logical_and.accumulate(front, 1).sum(1) + np.logical_and.accumulate(back, 1).sum(1)
        out[order[lo:hi]] = shared >= np.where(n == length[y], n - 1, n)
        lo = hi
    return out


def _verified(words: pa.Array, size: np.ndarray, scheme: Scheme, s: np.ndarray):
    """(a, b) of the near pairs within runs of ``size`` words that share no signature before the run's, ``s``."""
    chars, start, length = _chars(words)
    letters, halves = np.bitwise_or.reduceat(_U(1) << (chars.astype(np.uint64) % _U(64)), start), _Halves(chars, start, length)
    parts = scheme.of_parts(chars, start)
    bit = _U(1) << np.arange(scheme.parts, dtype=np.uint64)
    later = np.repeat(np.cumsum(size), size) - np.arange(len(words)) - 1  # partners after each word in its run
    total, lo, found = np.cumsum(later), 0, []
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - later[lo] + _PAIRS, "right")))
        n = later[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        on = np.bitwise_count(letters[a] ^ letters[b]) <= scheme.distance
        a, b = a[on], b[on]
        more = length[b] - length[a]
        a, b, more = np.where(more < 0, b, a), np.where(more < 0, a, b), np.abs(more)
        on = more <= 1
        on[on] = halves.agree(a[on], b[on], more[on])
        a, b = a[on], b[on]
        on = scheme.earliest[((parts[a] != parts[b]) * bit).sum(1).astype(np.int64)] == s[a]
        a, b = a[on], b[on]
        on = _one_edit(chars, start, length, a, b)
        found.append((a[on], b[on]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _signed(words: DataFrame, scheme: Scheme) -> DataFrame:
    def run(it):
        for batch in it:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                chars, start, length = _chars(part.column(0))
                g, row = scheme.signatures(scheme.of_parts(chars, start)), np.repeat(np.arange(len(part)), len(scheme.kept))
                yield pa.RecordBatch.from_arrays([pa.array(g.ravel().view(np.int64)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.tile(np.arange(len(scheme.kept), dtype=np.int32), len(part)))], ["g", "word", "n", "s"])

    return words.where("length(word) > 0").select("word", "n").mapInArrow(tidy(run), "g long, word string, n long, s int")


#: The narrower keys of a word: halves at its own length and at that of a word one shorter; the text without a letter.
_HALVES = "flatten(transform(filter(array(length(word), length(word) - 1), l -> l > 0), l -> array(xxhash64(g, l, 1, left(word, int(l div 2))), xxhash64(g, l, 2, right(word, int(l - l div 2))))))"
_LESS = "array_distinct(concat(array(xxhash64(g, word)), transform(sequence(1, length(word)), i -> xxhash64(g, concat(left(word, i - 1), substring(word, i + 1))))))"


def _met(keyed: DataFrame, scheme: Scheme, most: int | None) -> DataFrame:
    """(g, s, a, n_a, b, n_b): near pairs of equal g; of groups beyond ``most`` the single words, b null."""
    names = ["g", "s", "a", "n_a", "b", "n_b"]

    def alone(table):
        none = pa.nulls(len(table), pa.int64())
        return pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("g", "s", "word", "n")), none.cast(pa.string()), none], names)

    def pairs(table):
        g = np.asarray(table["g"])
        size = np.diff(np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]))
        wide = np.repeat(size > (most or len(g)), size)
        if wide.any():
            yield alone(table.filter(pa.array(wide)))
            table, size = table.filter(pa.array(~wide)), size[size <= most]
        if len(table):
            g, s, word, n = (table[c].combine_chunks() for c in ("g", "s", "word", "n"))
            a, b = (pa.array(x) for x in _verified(word, size, scheme, np.asarray(s)))
            yield pa.RecordBatch.from_arrays([g.take(a), s.take(a), word.take(a), n.take(a), word.take(b), n.take(b)], names)

    def run(it):
        left, open_g = None, None
        for batch in it:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            if open_g is not None:  # the rest of a group that is known to be large
                more = int(np.searchsorted(np.asarray(table["g"]), open_g, "right"))
                if more:
                    yield alone(table.slice(0, more))
                table = table.slice(more)
            if not len(table):
                left = None
                continue
            g = np.asarray(table["g"])
            open_g, done = None, int(np.searchsorted(g, g[-1]))  # ordered by g: the last group may go on
            if done:
                yield from pairs(table.slice(0, done))
            left = table.slice(done)
            if most and len(left) > most:
                yield alone(left)
                left, open_g = None, g[-1]
        if left is not None:
            yield from pairs(left)

    return keyed.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "g long, s int, a string, n_a long, b string, n_b long")


def near_pairs(words: DataFrame, distance: int = DISTANCE, first: int = FIRST, second: int = SECOND, group: int = GROUP) -> DataFrame:
    """(a, b, n_a, n_b): all pairs a < b of ``words`` (word, n; distinct words) that differ by exactly one inserted,
    deleted or replaced code point, each pair once."""
    scheme = Scheme(distance, first, second)
    ordered = "if(a < b, struct(a, b, n_a, n_b), struct(b as a, a as b, n_b as n_a, n_a as n_b)) as p"
    now = written(_met(_signed(words, scheme), scheme, group), "near")
    found, again = now.where("b is not null").selectExpr(ordered), None
    for keys, most in ((_HALVES, group), (_LESS, None)):
        wide = now.where("b is null").selectExpr("g", "s", "a as word", "n_a as n")
        now = written(_met(wide.select(F.explode(F.expr(keys)).alias("g"), "s", "word", "n"), scheme, most), "near")
        pairs = now.where("b is not null").selectExpr(ordered)
        again = pairs if again is None else again.union(pairs)
    return found.union(again.distinct()).select("p.*")  # within a large group a pair may share more than one key


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each word of ``forms`` (word, form) ends when forms are followed, by doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.alias("x").join(now.select(F.col("word").alias("at"), F.col("root").alias("to")), F.col("x.root") == F.col("at"), "left")
        now = written(step.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seen: int = SEEN, times: int = TIMES, noise: int | None = NOISE) -> DataFrame:
    """One row per distinct word of ``docs`` with at least ``length`` code points and ``seen`` occurrences: word, n
    (occurrences), n_near (words one edit away), form (the near word of largest n, ties to the smallest in
    code-point order, if its n is at least ``times`` the word's; else null), form_n, root (the last of the chain of
    forms; the word itself without a form).

    Texts are taken whole; null and empty ones have no words, a null id counts as empty where ``noise`` is used,
    repeated rows count each time, an empty table gives no rows, and other columns are not read.
    """
    words = written(occurrences(docs, id_col, text_col, length, noise).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seen), "words")
    pairs = near_pairs(words).select(F.explode(F.expr("array(struct(a as word, b as near, n_b as m, n_a as n), struct(b as word, a as near, n_a as m, n_b as n))")).alias("p")).select("p.*")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"), F.first("n").alias("own"))
    fits = F.expr(f"-best.less >= {times} * own")
    best = written(best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    root = roots(best.where("form is not null").select("word", "form"))
    out = words.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
