"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os

from claimlens.llm import bpe, exact_dedup, filter_audit, hard_negatives, lz_fingerprint, mixing, ngram_join, pii, quality_model, quality_rules
from claimlens.llm import substrings, token_counts, token_files
from claimlens.session import table


def vocabulary(name: str) -> str:
    """A file of a public tokenizer; TOKENIZER_DIR names another folder than the installed one."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark, sf_dir):
    return mixing.op1_mixing(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.op2_bpe(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_substrings(spark, sf_dir):
    return substrings.op3_substrings(table(spark, sf_dir, "documents"))


def op3_kept_spans(spark, sf_dir):
    return substrings.op3_kept_spans(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark, sf_dir):
    return ngram_join.op4_ngram_join(table(spark, sf_dir, "documents"))


def op5_lz_fingerprint(spark, sf_dir):
    return lz_fingerprint.op5_lz_fingerprint(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.op6_pii(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    return token_files.op7_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.op8_quality_rules(table(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.op9_token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_quality_model(spark, sf_dir):
    return quality_model.op10_quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark, sf_dir):
    return filter_audit.op11_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.op12_hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.op13_exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_bpe, op3_substrings, op3_kept_spans, op4_ngram_join, op5_lz_fingerprint,
        op6_pii, op7_token_files, op8_quality_rules, op9_token_counts, op10_quality_model,
        op11_filter_audit, op12_hard_negatives, op13_exact_dedup,
    )
}

ORACLE = {
    "op3_substrings": substrings.oracle(),
    "op3_kept_spans": substrings.kept_oracle(),
    "op8_quality_rules": quality_rules.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
    "op13_exact_dedup": exact_dedup.oracle(),
}
