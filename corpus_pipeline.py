"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a table that the next one reads."""

import uuid

from ripple.llm.common import table
from ripple.llm.cotrain import good_documents
from ripple.llm.decontam import clean_documents
from ripple.llm.hamming import distinct_documents
from ripple.llm.mixing import PLAN, mixed_documents
from ripple.llm.token_store import store_tokens
from ripple.session import scratch_root


def quality_stage(spark, docs, sf_dir):
    """Drop the documents that the co-trained classifier rejects."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """Keep the first document of each group of five-word-shingle similarity of 0.8 or more."""
    return distinct_documents(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Drop the documents that hold a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Take each leaf's token prefix; a row that is used in several epochs is repeated."""
    return mixed_documents(docs, PLAN)


def token_stage(spark, docs, sf_dir):
    """Write the token files and report what they hold, one row a document (and epoch), in the order of the ids."""
    return store_tokens(spark, docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the classifier, the signatures or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline_{name}_{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
