"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from farsight.llm.decontamination import op8_decontamination
from farsight.llm.fingerprints import op6_simhash
from farsight.llm import hard_negatives, lexical, licenses
from farsight.llm.line_dedup import op10_line_dedup
from farsight.llm.minhash_dedup import op4_minhash_dedup
from farsight.llm.packing import op5_packing
from farsight.llm.pii import op3_personal_data
from farsight.llm.quality import op1_ordinal_quality
from farsight.llm.sharding import op13_sharding
from farsight.llm.substring_dedup import op7_substring_dedup
from farsight.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_personal_data": op3_personal_data,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": licenses.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
}
