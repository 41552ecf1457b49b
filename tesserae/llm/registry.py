"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, lang_id, lattice, licenses, pii, simhash, token_files, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": decontaminate.query,
    "op2_warc_packages": warc.query,
    "op3_token_files": token_files.query,
    "op4_license_scan": licenses.query,
    "op5_byte_bpe": bpe.query,
    "op6_e8_lattice": lattice.query,
    "op7_lang_viterbi": lang_id.query,
    "op8_url_rules": url_rules.query,
    "op9_simhash_pivots": simhash.query,
    "op10_pii": pii.query,
}
ORACLES: dict[str, str] = {
    "op2_warc_packages": warc.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op8_url_rules": url_rules.ORACLE,
    "op10_pii": pii.ORACLE,
}
