"""Pipeline shapes over one preprocessing spec and one model.

All shapes give the same rows; they differ in where the work runs:

* ``chained``  two UDF projections; Spark evaluates them in one Python node
* ``fused``    one ``mapInArrow`` doing preprocess + predict per batch (flagship)
* ``fused_udf`` the same as one iterator UDF (the reference's fused form)
* ``native``   preprocess as a Catalyst expression, predict in Python
* ``staged``   job A writes the preprocessed tensor, job B scores it
* ``repartitioned`` shuffle the *raw* rows to ``n`` partitions, then score
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kiln.functions.preprocess import Preprocess
from kiln.models import ModelHandle
from kiln.operators.score import map_tensor, predict_map, predict_udf, preprocess_udf
from kiln.session import fresh_path
from kiln.sources.parquet import read_tensors, write_parquet


@dataclass
class ScoringPlan:
    preprocess: Preprocess
    model: ModelHandle
    column: str = "image"
    keep: list = field(default_factory=lambda: ["id"])
    output: str = "prediction"
    dtype: str = "float32"
    batch_size: int | None = None
    depth: int = 0
    flavor: str = "arrow"
    on_invalid: str = "raise"  # "null": rows that fail the spec get a null prediction; see ``rejects``

    @property
    def spec(self):
        return self.preprocess.input

    def _pre_udf(self, form="iterator"):
        return preprocess_udf(self.preprocess, form=form, flavor=self.flavor, on_invalid=self.on_invalid)

    def _predict_udf(self, spec, reuse="partition", form=None, preprocess=None):
        kw = {"flavor": self.flavor, "batch_size": self.batch_size, "on_invalid": self.on_invalid}
        if form:
            kw["form"] = form
        if (form or ("scalar" if reuse == "batch" else "iterator")) == "iterator":
            kw["depth"] = self.depth
        return predict_udf(self.model, spec, reuse=reuse, dtype=self.dtype, preprocess=preprocess, **kw)

    # I5
    def chained(self, df: DataFrame, form: str = "iterator", reuse: str = "partition") -> DataFrame:
        pre = self.preprocess
        staged = df.select(*self.keep, pre.output.tag(self._pre_udf(form)(F.col(self.column)), "tensor"))
        return staged.select(*self.keep, self._predict_udf(pre.output, reuse, form)(F.col("tensor")).alias(self.output))

    # I6
    def fused(self, df: DataFrame) -> DataFrame:
        return predict_map(df, self.model, self.column, self.spec, self.preprocess, self.output, self.keep,
                           self.dtype, self.batch_size, self.depth, on_invalid=self.on_invalid)

    # D13
    def rejects(self, df: DataFrame) -> DataFrame:
        """The rows that fail the input spec: their keys and a reason (``null``, ``length``, ``null element``).
        No Python step; with ``on_invalid="null"`` these are the rows whose prediction is null."""
        c, s = F.col(self.column), self.spec
        if s.encoding == "bytes":
            reason = F.when(c.isNull(), "null").when(F.octet_length(c) != s.nbytes, "length")
        else:
            reason = F.when(c.isNull(), "null").when(F.size(c) != s.size, "length").when(F.exists(c, lambda x: x.isNull()), "null element")
        return df.select(*self.keep, reason.alias("reason")).where("reason is not null")

    def fused_udf(self, df: DataFrame) -> DataFrame:
        u = self._predict_udf(self.spec, "partition", "iterator", preprocess=self.preprocess)
        return df.select(*self.keep, u(F.col(self.column)).alias(self.output))

    def native(self, df: DataFrame) -> DataFrame:
        pre = self.preprocess
        staged = df.select(*self.keep, pre.output.tag(pre.native(self.column), "tensor"))
        # a node between the expression and the UDF: Catalyst would make the expression the UDF's argument, and then
        # does not find it again where it adds or multiplies lambda variables (a resize)
        staged = staged.observe(Observation(), F.count(F.lit(1)).alias("rows"))
        return staged.select(*self.keep, self._predict_udf(pre.output)(F.col("tensor")).alias(self.output))

    # I7
    def stage_a(self, df: DataFrame, path: str, native: bool = False, handoff: str = "bytes") -> dict:
        """Job A: preprocess and persist (S6).  Returns the observed rows written.
        ``handoff="bytes"`` (the default) stores the tensor as raw little-endian values
        (one binary cell per row): cheaper to write, read and hand to Python than "array".
        ``native=True`` preprocesses with the Catalyst form (array hand-off only)."""
        pre = self.preprocess
        if native:
            return write_parquet(df.select(*self.keep, pre.output.tag(pre.native(self.column), "tensor")), path)
        out_spec = pre.output.with_(encoding="bytes") if handoff == "bytes" else pre.output
        out = map_tensor(df.select(*self.keep, self.column), self.column, pre.numpy, output="tensor",
                         keep=self.keep, spec=pre.input, out_spec=out_spec, on_invalid=self.on_invalid)
        return write_parquet(out, path)

    def stage_b(self, spark: SparkSession, path: str) -> DataFrame:
        """Job B: read the intermediate (S2) and score it."""
        staged = read_tensors(spark, path, "tensor", keep=self.keep)  # spec (and encoding) from the file
        return predict_map(staged, self.model, "tensor", None, None, self.output, self.keep,
                           self.dtype, self.batch_size, self.depth, on_invalid=self.on_invalid)

    def staged(self, spark: SparkSession, df: DataFrame, path: str | None = None, handoff: str = "bytes") -> DataFrame:
        """Runs job A now, returns job B's DataFrame.  The hand-off folder defaults
        to a fresh folder in the shared checkpoint dir, so it also cuts lineage."""
        path = path or fresh_path(spark, "kiln-stage")
        self.stage_a(df, path, handoff=handoff)
        return self.stage_b(spark, path)

    # B6
    def profiled(self, spark: SparkSession, df: DataFrame, profile, n: int | None = None) -> DataFrame:
        """Score fused under a stage-level ResourceProfile (e.g. 1 GPU per task)
        while the scan keeps the default profile.  A profile applies per stage,
        so the raw rows are shuffled to ``n`` partitions first (the smaller
        tensor; the preprocessed one never crosses the network)."""
        from kiln.operators.resources import require_profiles

        require_profiles(spark)
        src = df.select(*self.keep, self.column).repartition(n or df.rdd.getNumPartitions())
        return predict_map(src, self.model, self.column, self.spec, self.preprocess, self.output, self.keep,
                           self.dtype, self.batch_size, self.depth, profile=profile)

    # B3
    def repartitioned(self, df: DataFrame, n: int) -> DataFrame:
        """Round-robin the raw (smaller) rows to ``n`` partitions, then score fused.
        The reference repartitions the preprocessed tensor, which is 1.5x larger
        per image; shuffling the raw one moves less data for the same effect."""
        return self.fused(df.select(*self.keep, self.column).repartition(n))
