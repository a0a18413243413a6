"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

Counted as part of the subpackage llm.
"""

from __future__ import annotations

from claimlens.llm import bpe, mixing, ngram_join, pii, quality_model
from claimlens.llm.queries import vocabulary
from claimlens.session import materialize, table


def quality(spark, docs, sf_dir):
    """Drops documents that the quality classifier rejects."""
    return quality_model.accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group linked by five-word shingles with a Jaccard likeness of 0.8 or more."""
    return ngram_join.one_of_each_group(docs, k=5, percent=80)


def personal_data(spark, docs, sf_dir):
    """Masks personal data in the texts; all documents stay."""
    return pii.masked_documents(docs)


def mixture(spark, docs, sf_dir):
    """Takes every document as often as the mix of sources wants it."""
    return mixing.mixed_documents(docs)


def encoding(spark, docs, sf_dir):
    """Token counts and digests of ids and decoded text of every document taken."""
    return bpe.op2_bpe(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoding),
]

#: A model, a join by sketches and a tokenizer: SQL can't express these stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
