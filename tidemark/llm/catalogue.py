"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from tidemark.llm import bpe, chunking, exact, langid, licence, mixing, mtree, neardup, suffixes, variants, warc, webp, whitening

QUERIES = {
    "op1_licence_scan": licence.op1_licence_scan,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_topk_search": mtree.op3_topk_search,
    "op4_warc": warc.op4_warc,
    "op5_pivotal_mixing": mixing.op5_pivotal_mixing,
    "op6_language_id": langid.op6_language_id,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_substring_dedup": chunking.op8_substring_dedup,
    "op9_lossless_webp": webp.op9_lossless_webp,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_stateful_exact_dedup": exact.op12_stateful_exact_dedup,
    "op13_lanczos_whitening": whitening.op13_lanczos_whitening,
}

ORACLES = {
    "op1_licence_scan": licence.oracle(),
    "op2_suffix_dedup": suffixes.ORACLE,
    "op3_topk_search": mtree.ORACLE,
    "op4_warc": warc.oracle(),
    "op7_near_duplicates": neardup.ORACLE,
    "op12_stateful_exact_dedup": exact.ORACLE,
}
