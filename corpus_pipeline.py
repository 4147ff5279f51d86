"""The corpus pipeline: documents to token files, in five stages. Each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from evispark.llm import decontam, language_id, mixing, simhash, token_output
from evispark.llm.common import lean, scratch_dir, table
from evispark.llm.queries import tokenizer_path


def language(spark, docs, sf_dir):
    """Language ID: documents without letters (``und``) go; a null ``lang`` is filled with the language found.

    Null and empty texts have no letters and go; very long ones are read whole; ties go to the smaller language; repeated rows
    are judged alike; without labelled rows no language is known and every document stays; an empty table gives an empty table;
    other columns are kept whatever their names.
    """
    lean(spark)
    return language_id.accepted(docs)


def near_duplicates(spark, docs, sf_dir):
    """SimHash near-dedup: of each group the document with the smallest id stays.

    Null and empty texts have fingerprint zero and are one group; a null id stays only if its group has no other, ties by id go
    to the smallest hash of the text, and of repeated rows one stays; very long texts are read whole; an empty table gives an
    empty table; other columns are kept whatever their names.
    """
    lean(spark)
    return simhash.deduplicated(docs)


def decontaminate(spark, docs, sf_dir):
    """Benchmark decontamination: documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as do all where the benchmark is empty or has null texts only; very long texts are
    read whole; repeated rows are judged alike; an empty table gives an empty table; other columns are kept whatever their names.
    """
    lean(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Mixing sources to target weights: documents stand as often as the mix takes them, the last time cut to what is left.

    Null and empty texts have no words and go; a null source is a source of its own, last in order; null ids are kept; repeated
    rows share what is taken of them; an empty table gives an empty table; other columns are kept whatever their names.
    """
    lean(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark, docs, sf_dir):
    """Token-ID output: doc_id, start, n_tokens, ids_crc32 read back from the token files.

    A null text counts as empty and gives the end token; null ids come first, rows of one id in order of a hash of the text;
    very long texts are encoded whole; an empty table gives an empty table; other columns are left out.
    """
    lean(spark)
    return token_output.digest(token_output.tokenized(docs, tokenizer_path()))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]
#: Fingerprints, latent retrieval and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
