"""Personal data: patterns, and information-theoretic sanitisation of the words that reveal it.

Patterns find the protected entities (addresses, numbers).  A word of a document that mentions an entity reveals
it if the corpus says so: with N documents, n(e) that mention the entity, n(t) that hold the word and n(t, e) that
mention the entity and hold the word outside of entities, the word's pointwise mutual information
log2(N n(t,e) / (n(t) n(e))) is held against the entity's own information content log2(N / n(e)).  A word that
gives away ``disclosure`` of it or more is generalised, wherever it stands in a document that mentions the entity,
to its class (NUMBER, NAME, WORD) if the class itself does not reveal the entity, and removed otherwise.  Words
seen with an entity in one document only are judged like all others.

All counts are over the whole corpus and whole documents.  As n(t, e) <= n(e), a word can only reach the
threshold if n(t) <= N^(1 - disclosure) n(e)^disclosure: only such pairs are formed.  Entities that stand in the
same documents are judged as one.  Document counts of words are summed in the tasks that read them, and only those
of words of documents with entities are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import words as W
from kiln.llm.scratch import sized, tidy, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
CLASSES = ("NUMBER", "NAME", "WORD")
#: Share of an entity's information.
DISCLOSURE = 0.9

_COMPILED = tuple(re.compile(p) for p in PATTERNS)
# The same matches in linear time: a start inside a run of digits meets the end that the run's first start meets.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.zeros(256, bool)  # letters, digits, all of other scripts
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
_PLAIN[128:] = True
#: Runs of words whose counts are held before they are sent on.
_HELD = 4_000_000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _holds(kind: int, match: str) -> bool:
    if kind == 1:
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in match.split("."))
    digits = re.sub("[^0-9]", "", match) if kind else ""
    return {0: True, 2: 13 <= len(digits) <= 19, 3: 9 <= len(digits) <= 15}[kind] and (kind != 2 or luhn(digits))


def _emails(text: str):
    """(start, end) of the first pattern's matches: from each ``@``, back over what may stand before it and on over the
    domain.  A part before ``@`` begins behind the last match and the last ``@`` at the earliest."""
    end, at = 0, text.find("@")
    while at >= 0:
        run = text[end:at]
        start = end + len(run.rstrip(_LOCAL))
        end = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", end)


def _matches(kind: int, text: str):
    if kind == 0:
        return _emails(text)
    return ((m.start(), m.end()) for m in (_IP if kind == 1 else _COMPILED[kind]).finditer(text))


def entities(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    hints = ("@", ".", "", "+")
    return [(k, a, b) for k in range(len(KINDS)) if hints[k] in text for a, b in _matches(k, text) if _holds(k, text[a:b])]


class _Terms:
    """The words of a block without punctuation around them, in lower case: hash, class."""

    def __init__(self, data, offsets):
        self.start, self.end, self.row = W.spans(data, offsets)
        plain = _PLAIN[data]
        at = np.flatnonzero(plain)
        if not len(at):
            self.start = self.end = self.row = self.cls = np.zeros(0, np.int64)
            self.term = np.zeros(0, np.uint64)
            return
        lo = at[np.minimum(np.searchsorted(at, self.start), len(at) - 1)]
        hi = at[np.maximum(np.searchsorted(at, self.end) - 1, 0)] + 1
        ok = (lo >= self.start) & (lo < self.end) & (hi > lo)
        self.start, self.end, self.row = lo[ok], hi[ok], self.row[ok]
        self.term = W.hashes(_LOWER[data], self.start, self.end)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        first = data[self.start]
        self.cls = np.where(digits[self.end] > digits[self.start], 0, np.where((first >= 65) & (first <= 90), 1, 2))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, entities, text): each entity of a row once; the text only of rows with entities."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(it):
        for batch in it:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in W.blocks(column):
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                entity: list[list[str]] = [[] for _ in range(hi - lo)]
                texts: list[str | None] = [None] * (hi - lo)
                hint = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
                for r in np.unique(np.searchsorted(offsets, hint, "right") - 1).tolist():
                    text = data[offsets[r] : offsets[r + 1]].tobytes().decode()
                    if found := entities(text):
                        spans[r] = [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found]
                        entity[r] = sorted({f"{KINDS[k]}:{text[a:b].lower()}" for k, a, b in found})
                        texts[r] = text
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(spans, pa.list_(span)), pa.array(entity, pa.list_(pa.string())), pa.array(texts, pa.string())], ["doc_id", "spans", "entities", "text"]
                )

    return docs.mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:int,end:int>>, entities array<string>, text string")


def _words(text: str, found: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, class, start and end (in code points) of the words of a text outside its entities."""
    raw = np.frombuffer(text.encode(), np.uint8)
    t = _Terms(raw, np.array([0, len(raw)]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # bytes to code points
    start, end = points[t.start], points[t.end]
    inside = np.zeros(points[-1] + 1, np.int64)
    for s in found:
        inside[s["start"]] += 1
        inside[s["end"]] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(inside) > 0)])
    free = covered[end] == covered[start]
    return t.term[free].view(np.int64), t.cls[free], start[free], end[free]


def _terms(found: DataFrame) -> DataFrame:
    """(row, term): the words of rows with entities, and their classes (as the terms 0, 1, 2), each once a row."""

    def run(it):
        for batch in it:
            for row, spans, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                term, cls, _, _ = _words(text.as_py(), spans.as_py())
                own = np.unique(np.concatenate([term, cls.astype(np.int64)]))
                for lo in range(0, len(own), 1 << 16):
                    part = own[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row.as_py(), np.int64)), pa.array(part)], ["row", "term"])

    return found.where("text is not null").select("row", "spans", "text").mapInArrow(tidy(run), "row long, term long")


def _marked(found: DataFrame) -> DataFrame:
    """(doc_id, spans) from (doc_id, spans, text, marks): every word of a text whose term is marked; the bits of a
    mark are the classes that reveal as well."""
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))

    def marked(spans: list[dict], text: str | None, marks: list[dict] | None) -> list[dict]:
        all_ = [s | {"replacement": f"[{s['kind'].upper()}]"} for s in spans]
        if marks:
            bits = {m["term"]: m["bits"] for m in marks}
            term, cls, start, end = _words(text, spans)
            for i in np.flatnonzero(np.isin(term, np.array(list(bits), np.int64))).tolist():
                c = int(cls[i])
                all_.append({"kind": "term", "start": int(start[i]), "end": int(end[i]), "replacement": "" if bits[int(term[i])] >> c & 1 else f"[{CLASSES[c]}]"})
        return all_

    def run(it):
        for batch in it:
            rows = (batch.column(i).to_pylist() for i in range(1, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([marked(*r) for r in zip(*rows, strict=True)], out)], ["doc_id", "spans"])

    return found.mapInArrow(tidy(run), "doc_id long, spans array<struct<kind:string,start:int,end:int,replacement:string>>")


def _document_counts(docs: DataFrame) -> DataFrame:
    """(term, n): documents that hold each word, and each class (as the terms 0, 1, 2), summed in part."""

    def flush(held):
        term, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        own, which = np.unique(term, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(which, n, len(own)).astype(np.int64))], ["term", "n"])

    def run(it):
        held, size = [], 0
        for batch in it:
            for _, _, data, offsets in W.blocks(batch.column(0)):
                t = _Terms(data, offsets)
                row, term = np.concatenate([t.row, t.row]), np.concatenate([t.term, t.cls.astype(np.uint64)])
                order = np.lexsort((term, row))
                new = np.ones(len(order), bool)
                new[1:] = (row[order[1:]] != row[order[:-1]]) | (term[order[1:]] != term[order[:-1]])
                own, n = np.unique(term[order[new]], return_counts=True)
                held.append((own, n))
                size += len(own)
                if size > _HELD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(tidy(run), "term long, n long")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points, replacement), by kind as listed, the
    words that reveal an entity (kind ``term``) last, then by start.

    An entity's replacement is its kind in brackets, a word's its class, or '' where the class reveals too.  Null
    text counts as empty.  Null or repeated ids and equal rows each give a row and count as documents; an empty
    table gives none; other columns are not read.  Texts are searched whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(_found(rows).withColumn("row", F.monotonically_increasing_id()), "entities")
    n_docs = float(max(1, found.count()))
    # entities of the same documents have the same verdicts: they are one group, known by two hashes of its rows
    group = ["n_e", "h", "k"]
    mentions = found.select("row", F.explode("entities").alias("entity"))
    of = written(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("k")), "groups")
    groups = written(mentions.join(of, "entity").select("row", *group).distinct(), "mentions")
    # n_te <= n_e, so a word in more documents than this cannot reach the threshold; the margin is for rounding
    most = F.lit(n_docs ** (1 - disclosure) * (1 + 1e-6)) * F.pow("n_e", F.lit(disclosure))
    terms = written(_terms(found), "terms")
    candidates = written(terms.select("term").distinct(), "candidates")
    held = _document_counts(rows.select("text")).join(sized(candidates, 16), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))
    top = F.broadcast(groups.agg(F.max("n_e").alias("n_e")).select(F.coalesce(most, F.lit(0.0)).alias("top")))
    held = written(held.join(top, F.col("n_t") <= F.col("top")).drop("top"), "held")
    pairs = written(terms.join(sized(held, 32), "term").join(sized(groups, 48), "row").where(F.col("n_t") <= most), "pairs")
    share = F.log2(F.lit(n_docs) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.greatest(F.log2(F.lit(n_docs) / F.col("n_e")), F.lit(1e-9))
    joint = pairs.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_t").alias("n_t"))
    reveals = written(joint.where(share >= disclosure).select(*group, "term"), "reveals")
    general = reveals.where(f"term between 0 and {len(CLASSES) - 1}").groupBy(*group).agg(F.bit_or(F.expr("shiftleft(1, cast(term as int))")).alias("bits"))
    marks = pairs.join(sized(reveals, 64), [*group, "term"]).join(general, group, "left").groupBy("row", "term").agg(F.bit_or(F.coalesce("bits", F.lit(0))).alias("bits"))
    each = marks.where(f"term not between 0 and {len(CLASSES) - 1}").groupBy("row").agg(F.collect_list(F.struct("term", "bits")).alias("marks"))
    return _marked(found.select("row", "doc_id", "spans", "text").join(each, "row", "left").select("doc_id", "spans", "text", "marks"))
