"""Queries of the operators of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from acadspark.llm import automata, rules, tries
from acadspark.llm.common import table
from acadspark.llm.media import media_report
from acadspark.llm.mixing import mix_report
from acadspark.llm.ngrams import jaccard_report
from acadspark.llm.packing import pack_report
from acadspark.llm.repeats import repeats_report
from acadspark.llm.secrets import secrets_report
from acadspark.llm.sharding import shard_report
from acadspark.llm.tokens import tokens_report
from acadspark.llm.toxicity import toxicity_report
from acadspark.llm.whitening import whitening_report

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    return repeats_report(table(spark, sf_dir, "documents"))


@query("op6_separator_scan")
def op6(spark, sf_dir):
    return tokens_report(table(spark, sf_dir, "documents"))


@query("op7_media_tiles")
def op7(spark, sf_dir):
    return media_report(table(spark, sf_dir, "documents"))


@query("op10_pow2_packing")
def op10(spark, sf_dir):
    return pack_report(table(spark, sf_dir, "documents"))


@query("op4_line_rules", rules.SQL)
def op4(spark, sf_dir):
    return rules.rules_report(table(spark, sf_dir, "documents"))


@query("op5_budget_mix")
def op5(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


@query("op8_label_shards")
def op8(spark, sf_dir):
    return shard_report(table(spark, sf_dir, "documents"))


@query("op3_markov_secrets")
def op3(spark, sf_dir):
    return secrets_report(table(spark, sf_dir, "documents"))


@query("op9_noisy_or_toxicity")
def op9(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_fragment_join")
def op2(spark, sf_dir):
    return jaccard_report(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    return whitening_report(table(spark, sf_dir, "embeddings"))


@query("op12_substring_automata", automata.SQL)
def op12(spark, sf_dir):
    return automata.automata_report(table(spark, sf_dir, "documents"))


@query("op13_conversation_trie", tries.SQL)
def op13(spark, sf_dir):
    return tries.trie_report(table(spark, sf_dir, "conversations"))
