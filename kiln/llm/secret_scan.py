"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text.  The ledger, a parquet table, has a row for
each pair of blob and rule version that was scanned, with what was found.  A scan reads only texts whose blob
and rule version the ledger lacks, once however many documents hold it, appends them, and joins the findings
back to all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.scratch import sized, tidy, written
from kiln.llm.redact import replaced


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched for leftmost and without overlap; a match counts if the group ``part`` has ``least``
    characters or more.  ``hints``: a text without any of them in lower case cannot match.  A change of any of
    these needs a new ``version``."""

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("private key-----",)),
)

_FOUND = "array<struct<start:int,end:int>>"


def find(text: str, lower: str, rule: Rule, pattern: re.Pattern) -> list[dict]:
    if rule.hints and not any(x in lower for x in rule.hints):
        return []
    return [{"start": m.start(), "end": m.end()} for m in pattern.finditer(text) if len(m[rule.part]) >= rule.least]


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each blob and rule of ``todo`` (indices of ``rules``)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(it):
        patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in it:
            out: list[tuple] = []
            for blob, text, todo in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lower = text.lower()
                out += [(blob, rules[i].kind, rules[i].version, find(text, lower, rules[i], patterns[i])) for i in todo]
            names = ["blob", "kind", "version", "found"]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.binary(), pa.string(), pa.int32(), kind], strict=True)], names)

    return blobs.select("blob", "_text", "todo").mapInArrow(tidy(run), f"blob binary, kind string, version int, found {_FOUND}")


def _ledger(spark, path: str) -> DataFrame:
    schema = f"blob binary, kind string, version int, found {_FOUND}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, blob, spans (kind, start, end in code points; ordered by start, then as the
    rules are listed); ``ledger`` is a folder that all executors share, made at the first scan.

    Null text counts as empty.  Null or repeated ids and equal rows each give a row; an empty table gives none;
    other columns are not read.  Texts are scanned whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("blob", F.unhex(F.sha2("_text", 256)))
    paths = written(rows.select("doc_id", "blob"), "paths")
    # of all documents that hold a blob, those with the smallest id are read
    blobs = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("_reader"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for i, r in enumerate(rules)])
    pairs = blobs.withColumn("r", F.explode(wanted)).select("blob", "_reader", "r.*")
    known = _ledger(spark, ledger).select("blob", "kind", "version")
    unseen = pairs.join(known, ["blob", "kind", "version"], "left_anti").groupBy("blob", "_reader").agg(F.sort_array(F.collect_list("i")).alias("todo"))
    unseen = written(unseen, "unseen")
    read = rows.withColumn("_reader", F.coalesce("doc_id", F.lit(2**63 - 1))).join(sized(unseen, 96, 32 << 20), ["blob", "_reader"])
    _scanned(read, rules).dropDuplicates(["blob", "kind", "version"]).write.mode("append").option("compression", "zstd").parquet(ledger)
    return paths.join(findings(spark, ledger, rules), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


def findings(spark, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the current rule versions found something."""
    rank = F.expr("case " + " ".join(f"when kind = '{r.kind}' and version = {r.version} then {i}" for i, r in enumerate(rules)) + " end")
    # a pair that two scans appended counts once
    found = _ledger(spark, ledger).where(F.size("found") > 0).dropDuplicates(["blob", "kind", "version"]).withColumn("rank", rank).where("rank is not null")
    spans = found.select("blob", "kind", "rank", F.explode("found").alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), "rank", F.col("s.end").alias("end"), "kind").alias("s"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("s")).select("blob", F.expr("transform(s, x -> struct(x.kind as kind, x.start as start, x.end as end))").alias("spans"))


def redacted(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding of the ledger replaced by ``mark``; call ``scan`` before.  Same rows and columns,
    whatever their names; null text stays null, an empty table gives no rows, texts are taken whole."""
    spans = written(findings(docs.sparkSession, ledger, rules), "findings")
    most = spans.agg(F.sum(F.size("spans") * 32 + 64)).first()[0] or 0
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.col(text_col), 256)).alias("blob"))
    marked = rows.join(F.broadcast(spans) if most <= 16 << 20 else spans, "blob", "left").withColumn("text", replaced("text", "spans", mark))
    return marked.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
