"""The queries of this subpackage, by the names under which __spark_entry__.py registers them."""

from __future__ import annotations

from skyledger.llm.decontaminate import OP4_SQL, op4_decontamination
from skyledger.llm.language_id import op1_language_id
from skyledger.llm.licenses import OP9_SQL, op9_licenses
from skyledger.llm.mixing import OP10_SQL, op10_mixing
from skyledger.llm.quality import op8_quality
from skyledger.llm.sharding import op7_sharding
from skyledger.llm.simhash import op3_simhash
from skyledger.llm.toxicity import op6_toxicity
from skyledger.llm.vafile import OP5_SQL, op5_topk
from skyledger.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_mixing": op10_mixing,
}

#: DuckDB SQL, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_topk": OP5_SQL,
    "op9_licenses": OP9_SQL,
    "op10_mixing": OP10_SQL,
}
