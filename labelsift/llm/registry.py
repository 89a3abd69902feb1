"""Queries of the operators, and their oracle SQL where SQL can express it."""

from __future__ import annotations

from labelsift.llm import (bpe, ctph, fertility, fim, langid, merkle, mixing, secretscan, sharding, simhash, substrings,
                           unigram, urlfilter)


def queries() -> dict:
    return {
        "op1_ctph": ctph.op1_ctph,
        "op2_string_kernel": langid.op2_string_kernel,
        "op3_url_cascade": urlfilter.op3_url_cascade,
        "op4_bucket_refinement": substrings.op4_bucket_refinement,
        "op5_transducer_bpe": bpe.op5_transducer_bpe,
        "op6_fertility": fertility.op6_fertility,
        "op7_simhash": simhash.op7_simhash,
        "op8_secret_worklist": secretscan.op8_secret_worklist,
        "op9_trie_unigram": unigram.op9_trie_unigram,
        "op10_soft_mixing": mixing.op10_soft_mixing,
        "op11_minimax_shards": sharding.op11_minimax_shards,
        "op12_arrow_fim": fim.op12_arrow_fim,
        "op13_slot_merkle": merkle.op13_slot_merkle,
    }


def oracle_sql() -> dict:
    return {
        "op3_url_cascade": urlfilter.OP3_SQL,
        "op11_minimax_shards": sharding.OP11_SQL,
        "op12_arrow_fim": fim.OP12_SQL,
        "op13_slot_merkle": merkle.OP13_SQL,
    }
