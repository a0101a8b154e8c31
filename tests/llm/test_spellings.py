import random
import zlib
from collections import Counter

import pytest

from kiln.llm import spellings


def brute_words(rows, noise=31, length=7):
    n = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if noise and h % noise == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= length:
                    n[run] += 1
            run = ""
    return n


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, noise=31, seen=2, times=10):
    n = {w: c for w, c in brute_words(rows, noise).items() if c >= seen}
    form, count = {}, {}
    for w in n:
        other = sorted((x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(x, w)), key=lambda x: (-n[x], [ord(c) for c in x]))
        count[w] = len(other)
        if other and n[other[0]] >= times * n[w]:
            form[w] = other[0]
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], count[w], n[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    random.seed(4)
    base = ["separate", "definitely", "accommodate", "Österreich", "necessary", "aaaaaaaa", "rhythmic", "abcabcabc", "ÀÁÂÃÄÅÆÇ", "÷×ÿþýüûú", "committee"]
    out = [(i, " ".join(random.choice(base) for _ in range(40))) for i in range(30)]
    for i in range(60):
        w = random.choice(base).lower()
        at, kind = random.randrange(len(w)), i % 3
        v = w[:at] + ("" if kind == 0 else random.choice("abeé") if kind == 1 else w[at] + random.choice("xyz")) + w[at + 1 :]
        out.append((100 + i, f"{v}, {v}2{v}-{random.choice(base)} {v}" + " tail" * (i % 2)))
    out += [(None, "separate seperate\tSEPARATE"), (None, None), (3, None), (4, ""), (5, "short wörd"), (6, "x" * 30_000), (7, "x" * 30_000), (8, "x" * 29_999 + " " + "x" * 29_999), out[0], out[0]]
    return out


@pytest.mark.parametrize("noise", [31, 3, None])
def test_groups_equal_brute_force(spark, rows, noise):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], "doc_id long, text string, word int, n int, g string, s string")
    got = found(spellings.group(docs, noise=noise))
    assert got == brute(rows, noise)
    assert any(r[1] for r in got)
    assert spellings.group(docs.where("false"), noise=noise).count() == 0


def test_whole_vocabulary_in_large_groups(spark):
    """Groups beyond the limit take the narrower keys and lose no pair."""
    random.seed(9)
    words = sorted({"".join(random.choice("abc") for _ in range(random.randint(4, 7))) for _ in range(700)} | {"a", "b", "ab", "ba"})
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    want = sorted((a, b, i + 1, j + 1) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b))
    for scheme, most in (((2, 1, 6), 512), ((2, 1, 6), 8), ((2, 1, 4), 3), ((2, 2, 3), 5), ((2, 3, 1), 1)):
        assert found(spellings.near_pairs(table, *scheme, group=most)) == want, (scheme, most)


def test_signatures_find_every_pair_within_two_letters():
    scheme = spellings.Scheme(2, 1, 6)
    for mask in range(1 << 6):
        near_enough = bin(mask).count("1") <= 2
        assert (scheme.earliest[mask] < len(scheme.kept)) == near_enough
