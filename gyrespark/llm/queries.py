"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from gyrespark.llm import bpe, combinations, fourrussians, interpolation, langid, mixing, quality, simhash, suffixes, turns, vptree, weaklabels, wordpiece
from gyrespark.llm.common import load

QUERIES = {
    "op1_deleted_interpolation": (lambda spark, d: interpolation.op1(load(spark, d, "documents")), None),
    "op2_kneser_ney_languages": (lambda spark, d: langid.op2(load(spark, d, "documents")), None),
    "op3_bpe_lexicon": (lambda spark, d: bpe.op3(load(spark, d, "documents")), None),
    "op4_line_first_quality": (lambda spark, d: quality.op4(load(spark, d, "documents")), quality.SQL),
    "op8_simhash_pigeonring": (lambda spark, d: simhash.op8(load(spark, d, "documents")), None),
    "op5_deep_shallow_dedup": (lambda spark, d: suffixes.op5(load(spark, d, "documents")), None),
    "op6_capped_water_filling": (lambda spark, d: mixing.op6(load(spark, d, "documents")), mixing.SQL),
    "op7_wordpiece_counts": (lambda spark, d: wordpiece.op7(load(spark, d, "documents")), None),
    "op9_vantage_point_trees": (lambda spark, d: vptree.op9(load(spark, d, "embeddings")), vptree.SQL),
    "op10_weak_label_scorer": (lambda spark, d: weaklabels.op10(load(spark, d, "documents")), None),
    "op11_token_combination_join": (lambda spark, d: combinations.op11(load(spark, d, "documents")), combinations.SQL),
    "op12_four_russians_negatives": (lambda spark, d: fourrussians.op12(load(spark, d, "embeddings")), fourrussians.SQL),
    "op13_checkpointed_turn_repair": (lambda spark, d: turns.op13(load(spark, d, "conversations")), turns.SQL),
}
