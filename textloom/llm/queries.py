"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import oracles
from textloom.llm.decontaminate import contaminated
from textloom.llm.media import media_digest
from textloom.llm.mixing import mixing_weights
from textloom.llm.passages import passage_classes
from textloom.llm.phrases import collocations
from textloom.llm.pii import pii_digest
from textloom.llm.quality import quality_scores
from textloom.llm.runs import run_digest
from textloom.llm.secrets import find_secrets
from textloom.llm.simhash import simhash_groups
from textloom.llm.suffixes import remove_repeats
from textloom.llm.token_output import encode_documents
from textloom.llm.toxicity import toxicity_scores
from textloom.shared import table


def op1_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_ranking(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity_grammar(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_groups(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_secret_links(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_media_columns(spark, sf_dir):
    return media_digest(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark, sf_dir):
    return passage_classes(table(spark, sf_dir, "documents"))


def op8_token_ids(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing_weights(table(spark, sf_dir, "documents"))


def op11_personal_data(spark, sf_dir):
    return pii_digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return run_digest(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality_ranking, op3_toxicity_grammar, op4_simhash_groups, op5_secret_links, op6_media_columns, op7_repeated_passages, op8_token_ids, op9_suffix_dedup, op10_mixing, op11_personal_data, op12_periodic_runs, op13_phrase_collocations)} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = oracles.ORACLE_SQL | {k: v for k, v in {"pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
