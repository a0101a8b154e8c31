import zlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kiln.llm import catalog, idfile, pack, tokens
from kiln.session import fresh_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"

SF = "/root/testdata/sf0.001"


def library(name):
    t = Tokenizer.from_file(tokens.file_of(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_equal_the_library(name):
    random.seed(5)
    bits = ["a", "Bc", "é", ".", ",", "'s", "'", " ", " ", "\n", "  ", "5", "×", "…", "ll", "!?", "\t", "日", " ", "<|endoftext|>"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(3000)] + ["", None, " ", "\n", "a b\nc d. e,"]
    want, got = library(name), []
    for _, _, ids, at in tokens.encoder(name).blocks(pa.array(texts), 1):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [want(t) for t in texts]


def test_pack_covers_every_id_once(docs):
    size, want = 256, library(BYTE)
    left = sorted((r.doc_id is None, r.doc_id or 0, want(r.text)) for r in docs.collect())
    rows = pack.pack(docs, BYTE, 1, size=size).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id is None, r.doc_id or 0), {}).setdefault(r.start, []).append((ids, r.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    total = sum(len(x[2]) for x in left)
    assert sum(r.length for r in rows) == total
    assert len(by_sequence) <= -(-total // size) + 3  # one partly filled sequence a block
    for null, doc, ids in left:
        at = 0
        while at < len(ids):
            piece, n = by_doc[null, doc][at].pop()
            assert n == len(ids) and piece == ids[at : at + len(piece)]
            at += len(piece)


def plain_assign(lengths, size, linear, quadratic):
    """Longest first, into the cheapest sequence with room for all of it; what fits nowhere fills the cheapest ones."""
    n = -(-sum(lengths) // size)
    held, cost, out = [0] * n, [0.0] * n, {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, out[i] = 0, []
        while start < lengths[i]:
            left = lengths[i] - start
            able = [s for s in range(n) if size - held[s] >= left] or [s for s in range(n) if held[s] < size]
            s = min(able, key=lambda s: (cost[s], s))
            part = min(left, size - held[s])
            out[i].append((s, held[s], start, part))
            held[s], cost[s], start = held[s] + part, cost[s] + linear * part + quadratic * part * part, start + part
    return [out[i] for i in range(len(lengths))]


def test_assign_takes_the_cheapest_with_room():
    parts = pack.assign(np.array([6, 5, 4, 3, 2]), 10, 1.0, 1.0)
    assert parts == [[(0, 0, 0, 6)], [(1, 0, 0, 5)], [(1, 5, 0, 4)], [(0, 6, 0, 3)], [(1, 9, 0, 1), (0, 9, 1, 1)]]
    rng = np.random.default_rng(4)
    for linear, quadratic in ((1.0, 0.0), (1.0, 1 / 64), (0.0, 1.0)):
        for n in (0, 1, 2, 30, 200):
            lengths = rng.integers(1, 64, n)
            assert pack.assign(lengths, 64, linear, quadratic) == plain_assign(lengths.tolist(), 64, linear, quadratic)


def test_query_columns_of_packing_and_id_files(spark):
    """The checksums of op1 and op4 against the tokenizer itself, over a whole table."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    byte, word = library(BYTE), library(WORD)
    seen = {d: 0 for d in text}
    for r in sorted(catalog.queries()["op1_pack"](spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = byte(text[r.doc_id])
        assert r.doc_tokens == len(ids) and r.start == seen[r.doc_id] and r.length <= 2048
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {d: len(byte(t)) for d, t in text.items()}
    at = 0
    for r in sorted(catalog.queries()["op4_idfile"](spark, SF).collect(), key=lambda r: r.doc_id):
        ids = word(text[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_id_files_round_trip(spark, docs, empty):
    want = library(WORD)
    path = fresh_path(spark, "test-ids")
    idfile.write_ids(docs, path, WORD, 1, shards=3)
    got = idfile.read_ids(spark, path).orderBy("start").collect()
    ids = sorted(((r.doc_id is not None, r.doc_id or 0, np.array(want(r.text), "<u2").tobytes()) for r in docs.collect()))
    at = 0
    for r, (known, doc, raw) in zip(got, ids, strict=True):
        assert (r.doc_id is not None, r.doc_id or 0, r.start) == (known, doc, at)
        assert np.frombuffer(r.ids, "<u4").tolist() == np.frombuffer(raw, "<u2").tolist()
        at += r.n_tokens
    path = fresh_path(spark, "test-ids")
    idfile.write_ids(empty, path, WORD, 1, shards=3)
    assert idfile.read_ids(spark, path).count() == 0
    assert pack.pack(empty, BYTE, 1).count() == 0


def test_code_of_every_width():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(x) + 1):
        control, data = idfile.encode(x[:n])
        assert len(control) == -(-n // 4)
        assert (idfile.decode(control, data, n) == x[:n]).all()


def test_plain_words_go_to_the_model_alone(monkeypatch):
    """Lower-case ASCII words have the library's ids without its normalizer and pre-tokenizer; all other pieces pass them."""
    random.seed(11)
    plain = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 14))) for _ in range(2000)]
    other = ["naïve", "x1", "42", "don't", "'s", "日本", "..", "I", "\x01", "a\x01b", "ﬁne", "é"]
    enc, seen = tokens.Encoder(tokens.file_of(WORD)), []
    whole = enc._lists
    monkeypatch.setattr(enc, "_lists", lambda x: seen.extend(x) or whole(x))
    texts = plain + other + [" ".join(plain[i : i + 9] + other) for i in range(0, 900, 9)]
    got = []
    for _, _, ids, at in enc.blocks(pa.array(texts), 1):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    want = library(WORD)
    assert got == [want(t) for t in texts]
    assert seen and not set(seen) & set(plain)
