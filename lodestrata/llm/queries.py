"""The p1_ to p4_ and p7_ to p9_ queries over the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import boilerplate, conversations, formatdups, leakage, lookalikes, packing, sql, textstats
from lodestrata.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every usable chat, in order, with one spelling of the roles."""
    chats = table(spark, sf_dir, "chat_conversations").select("conv_id", "mapping", "exported_at")
    lines = table(spark, sf_dir, "chat_lines").select("line_id", "conv_id", "node_id", "role", "text", "created_at")
    return conversations.rebuild(chats, lines)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of web pages that are not main body."""
    return boilerplate.site_lines(table(spark, sf_dir, "web_pages").select("page_id", "url", "site", "title", "content", "fetched_at"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every web page under its title."""
    return boilerplate.main_bodies(table(spark, sf_dir, "web_pages").select("page_id", "url", "site", "title", "content", "fetched_at"))


def _p3_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "sources").select(F.lit("title").alias("field_name"), F.col("id").alias("record_key"), F.col("title").alias("raw"))
    passages = table(spark, sf_dir, "chunks").select(F.lit("content").alias("field_name"), F.col("id").alias("record_key"), F.col("content").alias("raw"))
    return titles.unionByName(passages).withColumn("raw_id", lookalikes.string_id(F.col("raw")))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title and passage."""
    return lookalikes.consistent_form(_p3_strings(spark, sf_dir), ["field_name", "record_key"], "raw")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records whose strings differ but read the same."""
    return lookalikes.alike_pairs(lookalikes.consistent_form(_p3_strings(spark, sf_dir), ["field_name", "record_key", "raw_id"], "raw"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose strings have look-alikes, by class."""
    return lookalikes.alike_classes(lookalikes.consistent_form(_p3_strings(spark, sf_dir), ["field_name", "record_key", "raw_id"], "raw"))


def _p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdups.collapse(table(spark, sf_dir, "objects").select("hash", "content"), "hash", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other members of every group of bodies that differ only in formatting."""
    return _p4_groups(spark, sf_dir).filter("hash != rep_hash").select("rep_hash", "hash")


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group of bodies with its number of copies and of stored rows."""
    return formatdups.copies(_p4_groups(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one, for every size of container."""
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "packing_sizes"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.usage(p7_containers(spark, sf_dir), table(spark, sf_dir, "packing_sizes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item in one stretch."""
    return p8_leaks(spark, sf_dir).filter("kind = 'stretch'").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items in them, in one stretch or reworded, and how near they are."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "text", "question")
    return leakage.leaks(table(spark, sf_dir, "documents"), items)


def p9_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality figures of every document."""
    # A fixed table of under 200 rows.
    words = [r.word for r in table(spark, sf_dir, "common_words").select("word").distinct().collect() if r.word]
    documents = table(spark, sf_dir, "documents")
    model = textstats.fit_kinds(documents, table(spark, sf_dir, "doc_labels"), words)
    return textstats.document_figures(documents, words, model)


def p9_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every document that follow from counts of characters, words and lines."""
    names = ["n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_ratio", "end_punct_share"]
    return textstats.document_figures(table(spark, sf_dir, "documents"), []).select("doc_id", *names)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return p9_figures(spark, sf_dir).filter("text_kind != 'prose'").select("doc_id", "text_kind").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p7_containers": p7_containers,
    "p7_usage": p7_usage,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_figures": p9_figures,
    "p9_ratios": p9_ratios,
}

ORACLE_SQL = sql.ORACLE_SQL
