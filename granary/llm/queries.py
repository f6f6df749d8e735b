"""The subpackage's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import arrays, credentials, leakage, packing, pairs, repetition, sentences, subset, truncation
from granary.llm.neardup import Alike, NearDuplicates
from granary.session import cut


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# 1: truncation

TEXT_TABLES = (("training_rows", "row_id", "response", "source"), ("generated_rows", "seed_index", "solution", "openai_fingerprint"))


def ending_model(spark: SparkSession, d: str) -> truncation.Model:
    texts = [table(spark, d, name).select(arrays.text(text).alias("text")) for name, _, text, _ in TEXT_TABLES]
    return truncation.fit(reduce(DataFrame.unionByName, texts))


def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    model = ending_model(spark, d)
    found = []
    for name, id, text, source in TEXT_TABLES:
        rows = table(spark, d, name)
        limits = truncation.length_limits(truncation.lengths_of(rows, id, text, source))
        found.append(truncation.truncated(rows, id, text, source, model, limits).withColumn("record_table", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tokens = truncation.truncated_tokens(table(spark, d, "tokenized_rows"), "row_id", "input_ids", 2)
    texts = cut_texts(spark, d).where("cut").select("record_table", F.col("id").alias("record_id"))
    return texts.unionByName(tokens.where("cut").select(F.lit("tokenized_rows").alias("record_table"), F.col("id").alias("record_id"))).distinct()


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_texts(spark, d).groupBy("record_table", "source", "id").agg(F.max("cut").alias("cut"), F.max("censored").alias("censored"))
    return rows.groupBy("record_table", "source").agg(
        F.count("*").alias("n_records"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share"), F.sum(F.col("censored").isNotNull().cast("long")).alias("n_at_limit")
    )


# 2: credentials

CODE_TABLES = (("starcoderdata", "raw_index", "content"), ("seed_snippets", "seed_index", "seed"), ("generated_rows", "seed_index", "seed"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = [
        credentials.find_credentials(table(spark, d, name), id, text).select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), "start_char", "end_char")
        for name, id, text in CODE_TABLES
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each kind the vocabulary proposed, and how many their context alone."""
    found = [credentials.find_credentials(table(spark, d, name), id, text).select(F.lit(name).alias("record_table"), "kind", "evidence") for name, id, text in CODE_TABLES]
    return reduce(DataFrame.unionByName, found).groupBy("record_table", "kind", "evidence").agg(F.count("*").alias("n"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    found = [
        credentials.redact_credentials(table(spark, d, name), id, text).select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), "text", "n_masked")
        for name, id, text in CODE_TABLES
    ]
    return reduce(DataFrame.unionByName, found)


# 3: repetition


RESPONSES = ("row_id", "response", ["lang"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows")
    measured = repetition.repetition(rows, *RESPONSES, chosen=repetition.cutoffs(rows, *RESPONSES))
    return repetition.heavy(measured).select(F.col("id").alias("row_id")).distinct()


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    measured = repetition.repetition(table(spark, d, "training_rows"), *RESPONSES)
    return measured.select(F.col("id").alias("row_id"), "n_words", "n_covered", F.round("repeated_share", 6).alias("repeated_share"))


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return repetition.cutoffs(table(spark, d, "training_rows"), *RESPONSES)


# 4: broken pairs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "training_rows")
    limits = truncation.length_limits(truncation.lengths_of(rows, "row_id", "response", "source"))
    broken = truncation.truncated(rows, "row_id", "response", "source", ending_model(spark, d), limits)
    return pairs.defects(rows, "row_id", broken).withColumnRenamed("id", "row_id")


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    marked = cut(pairs.marks(table(spark, d, "training_rows"), "row_id"))
    return pairs.declining(marked).where(F.col("n_prompts") >= pairs.Settings().prompts)


# 5: near-duplicates


def near(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(table(spark, d, "training_rows"), "row_id", ["instruction", "response"], Alike(shingle=2, threshold=0.70))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).pairs().select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).groups().select(F.col("id").alias("row_id"), "class_id", "group_id", "links")


# 6: varied subsets


def p6_selected(spark: SparkSession, d: str) -> DataFrame:
    return subset.varied_subsets(table(spark, d, "training_rows"), table(spark, d, "subset_requests"))


# 7: containers


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_capacities"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each size: how many documents are held, how many of their tokens are missing or held twice, containers over the size, and whether 99 of 100 tokens of room are filled."""
    packed = p7_containers(spark, d)
    sizes = table(spark, d, "pack_capacities").where("capacity_id IS NOT NULL")
    bins = packed.join(sizes, "capacity_id").groupBy("capacity_id").agg(
        F.sum((F.col("n_tokens") > F.col("capacity_tokens")).cast("long")).alias("n_over"), (F.sum("n_tokens") / F.sum("capacity_tokens") >= 0.99).alias("full")
    )
    pieces = packed.select("capacity_id", F.explode("docs").alias("d")).select("capacity_id", "d.*")
    held = pieces.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.countDistinct("first_token").alias("starts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"))
    whole = (F.col("n") == F.col("last")) & (F.col("pieces") == F.col("starts"))
    docs = held.groupBy("capacity_id").agg(F.count("*").alias("n_docs"), F.sum((~whole).cast("long")).alias("n_broken"))
    return docs.join(bins, "capacity_id").select("capacity_id", "n_docs", "n_broken", "n_over", "full")


# 8: leakage


def spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), {"zh": 20})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).withColumnRenamed("id", "doc_id")


# 9: sentences


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"), "doc_id", "text", "lang").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(query)
}
