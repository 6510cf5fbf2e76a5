"""The corpus operators as registered queries, each over its whole tables with production parameters."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.llm import decontaminate, html, jaccard, langid, media, negatives, quality, spelling, sql, substring, suffixes, toxicity, urls
from atomweave.llm.bpe import Codec
from atomweave.llm.common import table


def tokenizer_path() -> str:
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Codec(spark, tokenizer_path()).fit(docs).digest(docs).drop("text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return model.score(docs).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), network).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


#: The rules that the url query is asked to apply.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good are the rows labelled so whose crc32 of the key isn't divisible by 5; the others are there to measure."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.resample(table(spark, sf_dir, "documents"), labels)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a recording, in the group of those that align."""
    return media.align(media.fingerprints(media.render(table(spark, sf_dir, "embeddings")), "vec_id"), "vec_id")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is wrong on purpose; anchors are the rows whose key is divisible by 100."""
    return negatives.mine(table(spark, sf_dir, "embeddings"), wrong_label=negatives.WRONG_LABEL)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_suffixes": op13_suffixes, "op11_spelling": op11_spelling, "op12_negatives": op12_negatives, "op9_media": op9_media, "op2_quality": op2_quality, "op8_substring": op8_substring, "op3_jaccard": op3_jaccard, "op5_urls": op5_urls, "op7_html": op7_html, "op6_language": op6_language, "op10_toxicity": op10_toxicity, "op4_decontaminate": op4_decontaminate, "op1_bpe": op1_bpe}


ORACLES: dict[str, str] = {"op3_jaccard": sql.OP3, "op4_decontaminate": sql.OP4, "op5_urls": sql.op5(URL_RULES), "op12_negatives": sql.OP12}
