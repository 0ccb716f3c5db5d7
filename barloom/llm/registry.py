"""Queries of the operators in this package, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    audit,
    audit_sql,
    chat,
    licenses,
    mixing,
    mixing_sql,
    packing,
    phrases,
    phrases_sql,
    pii,
    quality_model,
    repeats,
    rules,
    rules_sql,
    simhash,
    topk,
    topk_sql,
    urls,
    urls_sql,
)
from barloom.llm.tables import table, word_count

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document, range-sorted by first training position."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("words")
    )
    found = mixing.assign(docs, F.col("words"))
    first = F.element_at("uses", 1)["position"]
    return found.select(
        "doc_id", "size", "source_size", "target", "taken", F.when(F.size("uses") > 0, first).alias("position")
    ).orderBy(F.col("position").asc_nulls_last())


ORACLES["op2_mixing"] = mixing_sql.OP2

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    found = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op8_url_filters"] = urls_sql.OP8


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(table(spark, sf_dir, "documents"), path)
    digests = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.place(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).select(
        "doc_id",
        quality_model.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    found = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLES["op4_quality_rules"] = rules_sql.OP4


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every 50th vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLES["op3_topk"] = topk_sql.OP3


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of every conversation, with roles recovered from the texts alone."""
    told = table(spark, sf_dir, "conversations")
    model = chat.fit(told)
    found = chat.turns(chat.roles(told.drop("role"), model))
    return found.select(
        F.col("conv").alias("conv_id"),
        F.col("place").alias("turn"),
        F.col("part").cast("long").alias("part"),
        "role",
        chat.rendered(F.col("role"), F.col("text")).alias("rendered"),
    )


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings that earlier documents hold."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of every language."""
    found = phrases.collocations(phrases.phrase_counts(table(spark, sf_dir, "documents"), least=100))
    return phrases.ranked(found, 2000).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLES["op11_phrases"] = phrases_sql.OP11


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    words = F.transform("found.places", lambda p: p["word"])
    base, every = licenses.labels_of(F.col("found"))
    return found.select(
        "doc_id",
        "found.n_words",
        F.size("found.places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        base.alias("base_labels"),
        every.alias("labels"),
        "found.score",
    )


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in every order of the five filters."""
    failed = audit.failures(table(spark, sf_dir, "documents"))
    return audit.audit(audit.mask_counts(failed, table(spark, sf_dir, "labels")))


ORACLES["op13_filter_audit"] = audit_sql.OP13
