import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from kiln.llm import align
from kiln.llm.tokens import file_of

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokens():
    import sentencepiece

    lib = Tokenizer.from_file(file_of(A))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=file_of(B))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}

    def both(text):
        a = [(i, bytes(chars[c] for c in lib.id_to_token(i))) for i in lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        return a, b

    return both


def brute(rows):
    both, docs, count = tokens(), [], Counter()
    for doc, text in rows:
        a, b = both(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc, 0, 0, [], []))
            continue
        ends = [set(), set()]
        for side, out in zip((a, b), ends, strict=True):
            at = 0
            for _, x in side:
                at += len(x)
                out.add(at)
        common, groups = sorted(ends[0] & ends[1]), []
        for end in common:
            groups.append(([], []))
        for k, side in enumerate((a, b)):
            at, g = 0, 0
            for i, x in side:
                groups[g][k].append(i)
                at += len(x)
                g += at == common[g]
        links = [(i, j) for x, y in groups for i in x for j in y]
        count.update(set(links))
        docs.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (i, _), c in count.items():
        most[i] = max(most[i], c)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


ODD = [
    (100, "two  spaces   three "), (101, " leading"), (102, "   "), (103, " "), (104, "tab\there\n\nand\r\nlines"), (105, "emoji 😀 日本語 ﬁ ​ zero"),
    (106, "a literal ▁ mark"), (107, "▁"), (108, "<|endoftext|> <s> </s> <unk> <0x41> <pad>"), (109, "'s 't don't we'LL"), (110, "x" * 5000), (111, "=" * 333 + "-" * 777),
    (112, "\n"), (113, "\nfirst"), (114, "é" * 40 + " \x00 \x7f"), (115, "12345 6789.01"), (116, "non breaking　wide"), (117, "trailing \n "), (118, "a\x1cb \x85c"), (119, "x"), (120, "x x"),
]


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 2000])
def test_alignment_equals_brute_force(spark, docs, block_bytes):
    odd = spark.createDataFrame([(i, t, "s", 1, "x", 2) for i, t in ODD], docs.schema)
    both = docs.union(odd).repartition(4, "text")
    rows = [(r.doc_id, r.text) for r in both.collect()]
    got = sorted((tuple(r) for r in align.align(both, A, B, block_bytes=block_bytes).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 30


def test_empty_tables_and_texts_without_tokens(spark, docs, empty):
    assert align.align(empty, A, B).count() == 0
    none = docs.where("text is null or text = ''")
    assert {tuple(r)[1:] for r in align.align(none, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_whole_texts_where_cutting_is_not_safe(spark):
    import pyarrow as pa

    side = align.SentencePieces(B)
    texts = pa.array([t for _, t in ODD if "▁" not in t])
    cut = side.ids(texts)
    side.cut = False
    whole = side.ids(texts)
    assert cut[0].tolist() == whole[0].tolist() and cut[1].tolist() == whole[1].tolist()


def test_scan_of_blocks_holds_few_rows(spark, docs):
    """Rows of the blocks' table are megabytes wide: its scan decodes ``SCAN_BLOCKS`` of them at once, however many a file has."""
    from kiln.llm.scratch import written
    from kiln.sources.parquet import READER_BATCH

    before = spark.conf.get(READER_BATCH)
    table = written(spark.range(9).coalesce(1), "few", batch_rows=2)
    per_batch = table.sparkSession.conf.get(READER_BATCH)
    assert (per_batch, spark.conf.get(READER_BATCH)) == ("2", before)
    assert sorted(r.id for r in table.collect()) == list(range(9))
    assert align.align(docs, A, B).sparkSession.conf.get(READER_BATCH) == str(align.SCAN_BLOCKS)
