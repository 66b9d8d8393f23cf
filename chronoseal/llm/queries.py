"""The registered queries of this sub-package: one per operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.base import table
from . import (
    bpe,
    collocations,
    decontamination,
    exact_dedup,
    fitting,
    importance_resampling,
    language_mixture,
    line_dedup,
    quality,
    token_files,
    toxicity,
    url_templates,
    warc,
    weighted_minhash,
)
from .arrays import shared_path
from .fitting import held_out, training_row
from .registry import llm_query


def _tokenizer(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@llm_query()
def op1_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(training_row(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    predicted = (F.col("score") >= 0.3).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "n_matches", "weight")


@llm_query()
def op2_token_files(spark, sf_dir):
    path = shared_path(spark, "tokens")
    token_files.write_tokens(_documents(spark, sf_dir).select("doc_id", "text"), path, _tokenizer(), end_id=2)
    rows = token_files.read_tokens(spark, path).select("doc_id", "part", "at", "n_tokens", "ids")
    return token_files.with_starts(token_files.checksums(rows), path).select("doc_id", "start", "n_tokens", "ids_crc32")


@llm_query(f"WITH {decontamination.SQL.format(name='judged', docs='documents')} SELECT * FROM judged")
def op3_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@llm_query(f"WITH {line_dedup.SQL.format(name='kept', docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept")
def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@llm_query()
def op5_url_filters(spark, sf_dir):
    """The label of a page is that of the document its path names: bad if the quality is 0."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = fitting.one_label(table(spark, sf_dir, "labels"), "quality").select(F.col("doc_id").alias("__doc"), (1 - F.col("label")).alias("label"))
    number = F.try_to_number(F.regexp_extract(url_templates.path(F.col("url")), "([0-9]{1,18})[^0-9]*$", 1), F.lit("9" * 18)).cast("bigint")
    return url_templates.judge(pages.join(labels, number == F.col("__doc"), "left"), RULES)


@llm_query()
def op6_quality_rules(spark, sf_dir):
    judged = quality.judge(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "score", "kept")


@llm_query()
def op7_bpe_round_trip(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return bpe.round_trip(docs, bpe.build_codec(docs, _tokenizer()))


@llm_query(warc.SQL)
def op8_warc_captures(spark, sf_dir):
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.page_captures(warc.assemble(warc.read_archive(spark, path)))


@llm_query()
def op9_weighted_minhash(spark, sf_dir):
    return weighted_minhash.classes(_documents(spark, sf_dir))


@llm_query()
def op10_language_mixture(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = language_mixture.predict(docs, language_mixture.learn(docs.where(training_row(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


@llm_query(collocations.SQL)
def op11_phrase_collocations(spark, sf_dir):
    """The first 2,000 phrases of each language."""
    return collocations.collocations(_documents(spark, sf_dir).select("lang", "text"))


@llm_query(exact_dedup.SQL)
def op12_exact_dedup(spark, sf_dir):
    """Every document with the id that stays of its group of equal texts."""
    return exact_dedup.mark_copies(_documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


@llm_query()
def op13_importance_resampling(spark, sf_dir):
    """Every document with its weight towards ``benchmark``, and its rank in the draw of a quarter of them."""
    return importance_resampling.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
