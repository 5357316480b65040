"""From raw documents to packed sequences: quality, line dedup, near copies, secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written and read again before the next stage.  All but the last return the columns of documents,
with ``n_chars`` following the text.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navstead.llm.jaccard import ngram_jaccard_components
from navstead.llm.linededup import line_dedup
from navstead.llm.llm_queries import tokenizer_file
from navstead.llm.marks import with_mark
from navstead.llm.packing import best_fit_packing
from navstead.llm.quality import kept_documents
from navstead.llm.secrets import redacted
from navstead.session import TableScope, cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left = threading.local()


def staged(stage: Stage) -> Stage:
    """A stage that first drops the inner tables of the stage before it, whose result is written by then.

    Where ``docs`` still reads from them (a chain that nobody wrote), they stay until the application ends.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for scope in getattr(_left, "scopes", ()):
            names = {p.rsplit("/", 1)[-1] for p in scope.paths}
            if not any(n in f for f in docs.inputFiles() for n in names):
                scope.drop()
        with TableScope(spark) as own:
            out = stage(spark, docs, sf_dir)
        _left.scopes = [own]
        return out

    return run_stage


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@staged
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go."""
    return kept_documents(docs)


@staged
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the largest doc_id alone; a text may end up empty."""
    return counted(line_dedup(docs).select(*docs.columns))


@staged
def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component stays, with one row; rows without doc_id stay."""
    found = ngram_jaccard_components(docs)
    first = F.count_if(F.col("doc_id") == F.col("component_id")).alias("_n")
    odd = cut_lineage(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first).where("_n <> 1"))
    gone, many = odd.where("_n = 0").select("doc_id"), odd.where("_n > 1").select("doc_id")
    marked = with_mark(docs.where("doc_id IS NOT NULL"), gone)  # texts that surely stay are not shuffled
    kept = marked.where("NOT _listed").union(marked.where("_listed").join(gone, "doc_id", "left_anti").select(*marked.columns)).drop("_listed")
    if not many.isEmpty():  # rows that repeat a doc_id
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        kept = kept.withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return kept.select(*docs.columns).union(docs.where("doc_id IS NULL"))


@staged
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask."""
    return counted(redacted(docs))


@staged
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return best_fit_packing(docs, tokenizer_file("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_copy_stage), ("secret_scans", secret_stage), ("best_fit_packing", packing_stage),
]
#: Sequence numbers and byte-pair ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = TableScope(spark)
    for _, stage in STAGES[:-1]:
        with TableScope(spark) as own:
            docs = cut_lineage(stage(spark, docs, sf_dir))
        before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
