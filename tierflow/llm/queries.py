"""The registered queries of this package and their SQL."""
from __future__ import annotations

from tierflow.llm.decontaminate import op2_decontaminate
from tierflow.llm.language import op13_language
from tierflow.llm.licenses import op6_licenses
from tierflow.llm.minhash import op1_minhash
from tierflow.llm.mixing import op3_mix
from tierflow.llm.oracles import ORACLES
from tierflow.llm.quality import op5_quality
from tierflow.llm.secrets import op9_secrets
from tierflow.llm.spelling import op11_spelling
from tierflow.llm.suffix_sort import op7_suffix_sort
from tierflow.llm.suffix_tree import op4_suffix_tree
from tierflow.llm.tokens import op8_tokens
from tierflow.llm.vector_codes import op12_vector_codes
from tierflow.llm.warc import op10_warc

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix": op3_mix,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_suffix_sort": op7_suffix_sort,
    "op8_tokens": op8_tokens,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_spelling": op11_spelling,
    "op12_vector_codes": op12_vector_codes,
    "op13_language": op13_language,
}
