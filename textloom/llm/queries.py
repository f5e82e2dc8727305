"""The queries of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, langid, neardup, packing, quality_rules, quality_trees, repeats, sentencepieces, topk
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    encoded = sentencepieces.encode(_table(spark, sf_dir, "documents"), path)
    digests = encoded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"))
    decoded = sentencepieces.decode(digests, path, keep=["doc_id", "n_ids", "ids_crc32"])
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality_rules.apply_rules(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.cut_repeats(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), added_tokens=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.main_text(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _held_out(folds: int, fold: int) -> F.Column:
    """Whether the id's remainder is that of the held-out fold; a row without an id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)).alias("held_out")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality_trees.score(docs, quality_trees.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(quality_trees.FOLDS, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = chat.parse(text)
            said = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in loss)
            told = "".join(f"{role}\n{x}\n" for role, x in turns)
            out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = table.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    out = chat.format_trees(chat.linear(both))
    return out.select("tree", "formatted", "loss").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learn(docs))
    return out.select("doc_id", _held_out(langid.FOLDS, langid.HELD_OUT), "lang_pred", "score")


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_html_extraction": op7_html_extraction,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_language_id": op10_language_id,
}
