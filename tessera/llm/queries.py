"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import Vocabulary, bpe_digest, decode_bpe, encode_bpe
from tessera.llm.common import table
from tessera.llm.decontaminate import OP8_SQL, contamination, contamination_digest
from tessera.llm.exact import OP3_SQL, exact_dedup
from tessera.llm.language import predict_languages
from tessera.llm.lines import OP5_SQL, dedup_lines
from tessera.llm.mixing import OP9_SQL, mix_sources
from tessera.llm.neardup import OP10_SQL, near_duplicates
from tessera.llm.pages import extract_pages, pages_digest
from tessera.llm.personal import personal_digest, replace_personal
from tessera.llm.repeats import remove_repeats, repeats_digest
from tessera.llm.runs import periodic_runs, runs_digest, with_periodic_ends
from tessera.llm.secrets import scan_secrets, secret_digest
from tessera.llm.whitening import fit_whitening, whiten, whitening_digest


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(remove_repeats(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_digest(extract_pages(table(spark, sf_dir, "pages")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("removed")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(replace_personal(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    fit = fit_whitening(vectors)
    return whitening_digest(whiten(vectors, fit), fit)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(periodic_runs(with_periodic_ends(table(spark, sf_dir, "documents"))))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_digest(decode_bpe(encode_bpe(table(spark, sf_dir, "documents"), vocabulary), vocabulary))


QUERIES = (
    op1_suffix_dedup, op2_secret_scan, op3_exact_dedup, op4_page_text, op5_line_dedup,
    op6_surrogates, op7_language_id, op8_decontaminate, op9_mix_sources, op10_near_dedup,
    op11_whitening, op12_periodic_runs, op13_byte_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op8_decontaminate": OP8_SQL, "op9_mix_sources": OP9_SQL, "op10_near_dedup": OP10_SQL}
