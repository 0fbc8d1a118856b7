"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, divergence, gam, imi, lsh, mixing, periodic, pii, secrets, simhash, toxicity, urlfilter, warc
from panelkit.llm.common import remainder, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, bpe.public_path()).drop("text"), "doc_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its place and verdict; of the value only its digest."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "kind", "value_sha256", "score", "is_secret")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(table(spark, sf_dir, "embeddings"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    scored = gam.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.standard_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digests(periodic.with_runs(docs), "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_pii, op3_secrets, op4_ann, op5_mix, op6_quality, op7_toxicity, op8_simhash, op9_warc, op10_near_vectors, op11_url_rules, op12_source_audit, op13_periodic_runs, pipeline)}
ORACLES = {"op5_mix": mixing.MIX_SQL, "op9_warc": warc.DERIVATIVES_SQL, "op11_url_rules": urlfilter.JUDGE_SQL, "op12_source_audit": divergence.AUDIT_SQL}
