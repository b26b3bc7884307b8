"""The queries of this subpackage, and DuckDB SQL for those that SQL can express.  The pipeline is at the repository's top."""

from . import bpe, collocations, compression, languages, mixing, notices, quality, simhash, spotsigs, substrings, suffix_tree, unigram, variants

QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_quality_repetition": quality.op2_quality_repetition,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_spotsigs": spotsigs.op4_spotsigs,
    "spotsigs_near_duplicates": spotsigs.spotsigs_near_duplicates,
    "op5_suffix_tree_scores": suffix_tree.op5_suffix_tree_scores,
    "op6_pivotal_mixing": mixing.op6_pivotal_mixing,
    "op7_compression_quality": compression.op7_compression_quality,
    "op8_license_notices": notices.op8_license_notices,
    "op9_simhash_groups": simhash.op9_simhash_groups,
    "op10_unigram_counts": unigram.op10_unigram_counts,
    "op11_collocations": collocations.op11_collocations,
    "op12_language_families": languages.op12_language_families,
    "op13_spelling_variants": variants.op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_quality_repetition": quality.ORACLE_SQL,
    "op3_substring_dedup": substrings.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_spelling_variants": variants.ORACLE_SQL,
}
