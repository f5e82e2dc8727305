"""Corpus pipeline: each stage works on all that the stage before it kept, written as Parquet and read again.

quality classifier -> quality rules -> MinHash near-dedup -> suffix-array dedup -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import neardup, packing, quality_rules, quality_trees, repeats
from textloom.llm.queries import tokenizer
from textloom.llm.scratch import Scratch

LEAST_SCORE = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """The rows under numbered column names, which clash with none of an operator's own; those names, the id's and the text's."""
    names = [f"_column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score under LEAST_SCORE go."""
    trees = quality_trees.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names, _, text = _plain(docs)
    return quality_trees.score(plain, trees, text=text, keep=names).where(F.col("score") >= LEAST_SCORE).select(names).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or a learned rule go."""
    learned = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, names, _, text = _plain(docs)
    return quality_rules.apply_rules(plain, learned, text=text, keep=names).where("kept").select(names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id stays of each group (null last, then by text); ids may be null or repeated."""
    plain, _, ids, text = _plain(docs)
    return neardup.one_of_each(plain, text=text, ids=ids).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans are cut, to whole characters; a document of which nothing is left stays with an empty text."""
    plain, names, ids, text = _plain(docs)
    cut = repeats.cut_repeats(plain, text=text, ids=ids, keep_characters=True, carry=[c for c in names if c not in (ids, text)])
    left = F.decode("kept", "UTF-8")
    made = {text: left, **({names[docs.columns.index("n_chars")]: F.length(left).cast("long")} if "n_chars" in docs.columns else {})}
    return cut.select(*(made.get(c, F.col(c)).alias(c) for c in names)).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
