"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from . import alignment, ann, exact_dedup, fixity, katz, language, mixing, near_dedup, packing, pii, quality, spelling, toxicity

QUERIES = {
    "op1_fixity_audit": fixity.op1_fixity_audit,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality_resampling": quality.op3_quality_resampling,
    "op4_katz": katz.op4_katz,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_neighbours": ann.op7_neighbours,
    "op8_pii": pii.op8_pii,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_language": language.op11_language,
    "op12_spelling": spelling.op12_spelling,
    "op13_alignment": alignment.op13_alignment,
}
SQL = {"op1_fixity_audit": fixity.OP1_SQL, "op2_near_dedup": near_dedup.OP2_SQL, "op6_source_mixing": mixing.OP6_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op12_spelling": spelling.OP12_SQL}
