import hashlib
import re

import pytest
import xxhash

from kiln.llm import repeats, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("length, k", [(20, 8), (6, 3)])
def test_repeats_equal_brute_force(docs, length, k):
    first, want = {}, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        w = WORD.findall(r.text or "")
        gone = set()
        for a in range(len(w) - length + 1) if r.doc_id is not None else ():
            key = tuple(w[a : a + length])
            if key in first and first[key][0] != (r.doc_id, -1) and not (first[key][0] == r.doc_id and first[key][1] is not r):
                gone.update(range(a, a + length))
            first.setdefault(key, (r.doc_id, r))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = repeats.remove_repeats(docs, length=length, k=k).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept)) for r in got)
    for r in got:
        assert sum(x["end"] - x["start"] for x in r.repeats) == r.n_removed
        assert all(x["end"] - x["start"] >= length for x in r.repeats)


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies_equal_brute_force(docs, empty):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = sorted(repr((d, f, least[group[i]])) for i, (d, f) in enumerate(rows))
    got = simhash.near_copies(docs).collect()
    assert want == sorted(repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in got)
    assert simhash.near_copies(empty).count() == 0

    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(group))
    assert {r.doc_id for r in kept.collect()} == {least[g] for g in set(group)}


def test_trees_of_a_split_shard_lose_no_link(spark):
    import random

    random.seed(2)
    centre = random.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for _ in range(300)} | {random.getrandbits(64) for _ in range(200)}
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    stars = simhash.components(simhash.links(table, tree=40)).collect()
    root = {x: x for x in fps}
    for _ in fps:
        before = dict(root)
        for a in fps:
            for b in fps:
                if ((a ^ b) % 2**64).bit_count() <= 3:
                    root[a] = min(root[a], root[b])
        if root == before:
            break
    got = {x: x for x in fps} | {r.a: r.b for r in stars}
    assert got == root
