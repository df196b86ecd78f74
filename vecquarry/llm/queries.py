"""Queries of the training-data problems, over their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecquarry.llm import clusters, copies, encodings, language, leaks, lookalike, neighbours, overlaps, packing, sql, subjects
from vecquarry.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(table(spark, d, "datacomp_pool", "row_id", "text"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "datacomp_pool", "row_id", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "datacomp_pool", "row_id", "text"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_rows(table(spark, d, "datacomp_pool", "row_id", "text"), "row_id").select("row_id", "canon")


def _languages(spark: SparkSession, d: str) -> tuple:
    df = table(spark, d, "documents", "doc_id", "text", "lang")
    return df, language.train(df, "doc_id", "text", "lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(*_languages(spark, d))


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(*_languages(spark, d))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    df, cost = _languages(spark, d)
    return language.segments(df, "doc_id", "text", cost).withColumnRenamed("id", "doc_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    keys = {"documents": "doc_id", "datacomp_pool": "row_id"}
    return encodings.as_texts({t: (table(spark, d, t, k, "text"), k, "text") for t, k in keys.items()})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_rows(_texts(spark, d))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled_rows(_texts(spark, d), restore=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "laion_cache", "row_id", "image_features", "text_features")
    return neighbours.similar_vectors(df).select("direction", "row_id", "nn_row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "datacomp_pool", "row_id", "split", "text", "b32_img")
    return overlaps.cross_split_pairs(df).select("row_id_a", "row_id_b").distinct()


def p6_fractions(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_fractions(table(spark, d, "datacomp_pool", "row_id", "split", "text"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, d, "datacomp_pool", "row_id", "split", "source", "text", "b32_img"))


def _images(spark: SparkSession, d: str) -> dict:
    columns = {"datacomp_pool": "b32_img", "laion_cache": "image_features"}
    return {t: (table(spark, d, t, "row_id", c), "row_id", c) for t, c in columns.items()}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters_found(_images(spark, d))


def p7_described(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(_images(spark, d))


def _packs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_sizes")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(*_packs(spark, d))


def p8_filled(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(*_packs(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_passages", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_removals(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removals(_leaks(spark, d))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return leaks.cleaned(docs, leaks.removals(_leaks(spark, d)))


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents", "doc_id", "text", "applicant", "source"), table(spark, d, "subject_labels")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_found(*_subjects(spark, d))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(*_subjects(spark, d), table(spark, d, "subject_areas"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_collapsed, p2_found, p2_canonical, p3_found, p3_documents, p3_segments, p4_found, p4_restored, p5_found, p6_found, p6_fractions, p6_report, p7_found, p7_described,
        p8_packed, p8_filled, p9_found, p9_removals, p9_cleaned, p10_found, p10_composition,
    )
}
# The other queries have no twin: their searches are approximate, learned, or too slow as SQL on whole tables.
SQL: dict[str, str] = {"p1_found": sql.COPIES, "p1_collapsed": sql.COLLAPSED, "p2_found": sql.LOOKALIKE_PAIRS, "p2_canonical": sql.CANONICAL, "p9_found": sql.LEAKS}
