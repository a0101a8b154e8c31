"""Mixing sources to target weights by hash-threshold histograms, in DataFrame and SQL operations only.

Every document has a 60-bit hash of its id.  Words are summed by source and leading hash bits; the running sum
finds the bucket in which a source's budget ends, and only that bucket is looked at again with more bits, then
once more by whole hashes.  A document is taken if its hash lies below its source's threshold: no sort, no state
of the order of the corpus, and a larger budget takes all that a smaller one takes.

Sources are joined to documents by a broadcast only if their table is small; otherwise by a sort-merge join,
whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.scratch import BROADCAST_BYTES, written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits and the two leading parts that are looked at first.
BITS, FIRST, SECOND = 60, 12, 24


def _small(df: DataFrame) -> DataFrame:
    size = df.agg(F.sum(F.length("_source") * 4 + 96)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _boundary(histogram: DataFrame, budget: DataFrame, bucket: str) -> DataFrame:
    """(_source, bucket, rest, part): where a source's budget ends, what is left of it there, words there."""
    run = histogram.join(budget, "_source").withColumn("_run", F.expr(f"sum(words) over (partition by _source order by {bucket})"))
    return run.where("_run - words <= rest and rest < _run").select("_source", bucket, (F.col("rest") - F.col("_run") + F.col("words")).alias("rest"), F.col("words").alias("part"))


def targets(sizes: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(_source, source_size, target) from (_source, source, source_size): shares of ``share`` of all words by
    weight, none above ``cap`` times its source; what is over is shared again.

    With sources ordered by cap over weight, those that stop at their cap come first, so running sums over the
    sources tell each one's share of what those before it leave.
    """
    spark, view = sizes.sparkSession, "_kiln_mix_sources"
    sizes.createOrReplaceTempView(view)
    try:
        return spark.sql(f"""
            with ranked as (select *, row_number() over (order by source is null, source) - 1 as r from {view}),
            weighed as (select *, element_at(array({", ".join(str(int(w)) for w in weights)}), cast(r % {len(weights)} as int) + 1) as w, {float(cap)}D * source_size as most from ranked),
            summed as (select *, {float(share)}D * sum(source_size) over () as all_words, sum(w) over () as all_w,
                coalesce(sum(w) over (order by most / w, r rows between unbounded preceding and 1 preceding), 0) as w0,
                coalesce(sum(most) over (order by most / w, r rows between unbounded preceding and 1 preceding), 0D) as most0 from weighed),
            marked as (select *, w * (all_words - most0) / (all_w - w0) > most as full from summed),
            rest as (select *, all_words - sum(if(full, most, 0D)) over () as words_left, all_w - sum(if(full, w, 0)) over () as w_left from marked)
            select _source, source_size, if(full, most, w * words_left / w_left) as target from rest""")
    finally:
        spark.catalog.dropTempView(view)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with a source without null, a size and a hash."""
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    return docs.withColumns(
        {
            "_source": F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))),
            "_size": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"),
            "_h": F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"),
        }
    )


def _located(sizes: DataFrame, whole: DataFrame, budget: DataFrame) -> DataFrame:
    """(_source, _t, rest, part): the hash at which a source's budget (_source, rest) ends; ``whole`` has the words
    of ``sizes`` by source and leading bits."""
    first, second = F.expr(f"shiftright(_h, {BITS - FIRST})"), F.expr(f"shiftright(_h, {BITS - SECOND})")
    at = written(_boundary(whole.select("_source", "_b", "words"), budget, "_b"), "boundary")
    inside = sizes.withColumn("_b", first).join(_small(at.select("_source", "_b")), ["_source", "_b"], "left_semi")
    at = written(_boundary(inside.groupBy("_source", second.alias("_b")).agg(F.sum("_size").alias("words")), at.select("_source", "rest"), "_b"), "boundary")
    inside = sizes.withColumn("_b", second).join(_small(at.select("_source", "_b")), ["_source", "_b"], "left_semi")
    return _boundary(inside.groupBy("_source", F.col("_h").alias("_t")).agg(F.sum("_size").alias("words")), at.select("_source", "rest"), "_t")


def thresholds(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_source, source_size, target, copies, _t, rest, part) from (source, _source, _size, _h): every document is
    taken ``copies`` times, once more if its hash is below ``_t``; at ``_t`` lie ``part`` words, ``rest`` are left."""
    first = F.expr(f"shiftright(_h, {BITS - FIRST})")
    whole = written(sizes.groupBy("_source", "source", first.alias("_b")).agg(F.sum("_size").alias("words")), "histogram")
    goal = targets(whole.groupBy("_source", "source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goal = written(
        goal.withColumn("budget", F.floor("target"))
        .withColumn("copies", F.expr("if(source_size = 0, 0L, budget div source_size)"))
        .withColumn("rest", F.col("budget") - F.col("copies") * F.col("source_size")),
        "targets",
    )
    at = _located(sizes, whole, goal.where("rest > 0").select("_source", "rest"))
    return written(goal.select("_source", "source_size", "target", "copies").join(at, "_source", "left"), "thresholds")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, whole (copies taken whole), cut (words of
    one more copy that the budget cuts, else 0), taken (all words taken).

    Sources come by code point, null last, and take the weights in turn.  Null text is of size 0; an empty table
    gives no rows; other columns are not read.  Rows with equal ids have equal hashes: if a budget ends among
    them they share what is left by size, rounded down.  A null id has a hash of its own.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sizes = written(_keyed(plain, "doc_id", "text", "source").drop("text"), "sizes")
    state = thresholds(sizes, weights, share, cap)
    cut = F.expr("if(_h = _t, cast(floor(cast(_size as decimal(38, 0)) * rest / part) as long), 0L)")
    return (
        sizes.join(_small(state), "_source")
        .withColumn("whole", F.col("copies") + F.coalesce(F.expr("if(_h < _t, 1L, 0L)"), F.lit(0)))
        .withColumn("cut", F.coalesce(cut, F.lit(0)))
        .select("doc_id", F.col("_size").alias("size"), "source", "source_size", "target", "whole", "cut", (F.col("_size") * F.col("whole") + F.col("cut")).alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, whole: a row that the budget cuts is taken if the
    larger part of it is inside.  Rows without words are taken as often as their source's whole copies, once at
    least.  All columns are kept, whatever their names; null text has no words; an empty table gives no rows.

    If the budget ends among rows with equal ids or none, a hash of their columns decides among them, and a row's
    number only among rows that are equal in all: these rows are written with their hashes and the boundary is
    looked for once more, inside them.  So the rows taken do not depend on how the table is dealt to tasks.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sizes = written(_keyed(plain, "doc_id", "text", "source").drop("text"), "sizes")
    state = thresholds(sizes, weights, share, cap)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole_row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    rows = _keyed(rows, "doc_id", "text", "source").drop("doc_id", "text", "source").join(_small(state.drop("source_size", "target")), "_source")

    def taken(rows: DataFrame, inside: str) -> DataFrame:
        times = F.expr(f"cast(if(_size = 0, greatest(copies, 1L), copies + coalesce(if({inside}, 1L, 0L), 0L)) as int)")
        rows = rows.withColumn("_times", times).where("_times > 0")
        return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")

    shared = sizes.where("_size > 0").join(_small(state.select("_source", "_t")), "_source").where("_h = _t").groupBy("_source").count().where("count > 1")
    if not shared.limit(1).count():
        return taken(rows, "_h < _t or (_h = _t and 2 * rest >= part)")
    # what is written holds the rows' numbers, so all that follows sees the same ones
    lead = F.conv(F.substring(F.md5(F.to_json("row", {"ignoreNullFields": "false"}).cast("binary")), 1, 9), 16, 10).cast("long")
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << (BITS - 36)))
    at = written(rows.where("_h = _t and _size > 0").withColumn("_g", F.shiftleft(lead, BITS - 36) + number), "shared")
    inner = at.select("_source", F.col("_g").alias("_h"), "_size")
    whole = inner.groupBy("_source", F.expr(f"shiftright(_h, {BITS - FIRST})").alias("_b")).agg(F.sum("_size").alias("words"))
    ends = written(_located(inner, whole, state.where("_t is not null and rest > 0").select("_source", "rest")).select("_source", F.col("_t").alias("_u"), F.col("rest").alias("_rest"), F.col("part").alias("_part")), "inside")
    cut = taken(at.join(_small(ends), "_source", "left"), "_g < _u or (_g = _u and 2 * _rest >= _part)")
    return taken(rows.where("not coalesce(_h = _t and _size > 0, false)"), "_h < _t").unionByName(cut)
