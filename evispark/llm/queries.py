"""The corpus operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, chat_format, decontam, html_extract, language_id, license_scan, mixing, periodic, quality_rules, simhash, spelling, token_output, toxicity
from .common import table


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op6_chat_format(spark, sf_dir):
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


def op7_decontaminate(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_ids(spark, sf_dir):
    return token_output.digest(token_output.tokenized(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_html_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic.run_digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op6_chat_format": chat_format.ORACLE, "op12_quality_rules": quality_rules.oracle()}
