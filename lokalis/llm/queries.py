"""Queries of the training-data operators over the driver's tables; SQL for those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lokalis.llm import addresses, canonical_list, entity_match, eval_leaks, junk_pages, name_variants, packing, textforms
from lokalis.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match_places(table(spark, d, "venues"), table(spark, d, "osm_venues")).select("venue_key", "osm_id")


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.match_places(table(spark, d, "venues"), table(spark, d, "osm_venues"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return textforms.unusual_values(table(spark, d, "venue_refs"), "ref_id", ("name", "city")).selectExpr("id as ref_id", "field")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return textforms.canonical_values(table(spark, d, "venue_refs"), "ref_id", ("name", "city")).selectExpr("id as ref_id", "field", "canonical", "stand_ins")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(table(spark, d, "venue_refs"), table(spark, d, "resolutions")).select("ref_id", "res_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_list.map_values(table(spark, d, "venue_refs"), table(spark, d, "cities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.address_pairs(table(spark, d, "venue_refs"), table(spark, d, "cities")).select("ref_id_a", "ref_id_b")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.verbatim(eval_leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))).select("doc_id", "item_id")


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.reparameterised(eval_leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))).select("doc_id", "item_id", "template_words", "replaced")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return junk_pages.junk_pages(table(spark, d, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_confidence": p1_confidence, "p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p5_found": p5_found,
        "p6_found": p6_found, "p7_packed": p7_packed, "p8_found": p8_found, "p8_reparameterised": p8_reparameterised, "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    """None of these is SQL; tests/llm hold them against brute force and known cases."""
    return {}
