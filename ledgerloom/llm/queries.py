"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, fill_in_middle, html_text, language_id, line_dedup, pii, url_filter, vector_codes
from .common import table
from .embedding_dedup import near_duplicates
from .lattice_lm import lattice_scores
from .ngram_join import jaccard_components
from .packing import pack


def vocabulary() -> str:
    """Where the public vocabulary lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(spark, f"{sf_dir}/documents.parquet")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_html_text": op3_html_text,
        "op4_decontamination": op4_decontamination,
        "op5_lattice_lm": op5_lattice_lm,
        "op6_pii": op6_pii,
        "op7_ngram_join": op7_ngram_join,
        "op8_language_id": op8_language_id,
        "op9_url_filter": op9_url_filter,
        "op10_packing": op10_packing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_vector_codes": op13_vector_codes,
    }


#: All pairs of vectors; what links reach, step by step.
_EMBEDDING_SQL = """
    with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    u as materialized (select vec_id, e, sqrt(list_dot_product(e, e)) n from v where list_dot_product(e, e) > 0),
    l as materialized (select a.vec_id x, b.vec_id y from u a join u b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
    r as (select vec_id x, vec_id y from embeddings union select r.x, l.y from r join l on r.y = l.x),
    c as (select x vec_id, min(y) component_id from r group by x),
    k as (select x vec_id, count(*) n from l group by x)
    select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from c left join k using (vec_id)"""

#: All pairs of documents that share a shingle.
_NGRAM_SQL = r"""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from d, range(1, greatest(len(w) - 4, 1) + 1) t(i) where len(w) > 0),
    n as materialized (select doc_id, count(*) n from s group by doc_id),
    p as (select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
    l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 80 * (a.n + b.n - i)),
    e as materialized (select x, y from l union all select y, x from l),
    r as (select doc_id x, doc_id y from documents union select r.x, e.y from r join e on r.y = e.x),
    c as (select x doc_id, min(y) component_id from r group by x)
    select doc_id, coalesce(n, 0) n_shingles, component_id from c left join n using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": _EMBEDDING_SQL,
        "op7_ngram_join": _NGRAM_SQL,
        "op9_url_filter": url_filter.sql(),
        "op11_fill_in_middle": fill_in_middle.sql(),
        "op12_exact_dedup": exact_dedup.sql(),
        "op13_vector_codes": vector_codes.sql(),
    }
