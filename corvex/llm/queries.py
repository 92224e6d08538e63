"""The ten operators over their whole tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, license_scan, mixing, pii, quality_rules, secret_scan, simhash, substring_dedup, suffix_array, token_count
from .common import table


def op1_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark, sf_dir):
    return suffix_array.suffix_array_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "containment", "consistency")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_license_scan, op3_quality_rules, op4_secret_scan, op5_substring_dedup, op6_pii, op7_token_counts, op8_suffix_array_dedup, op9_mixing, op10_decontaminate)}
ORACLES = {"op2_license_scan": license_scan.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op9_mixing": mixing.ORACLE}
