"""The queries of this subpackage and their SQL, added to the entry module when importable."""

from __future__ import annotations

from umbra.llm.op1_lm import op1_lm
from umbra.llm.op2_simhash import op2_simhash
from umbra.llm.op3_license import OP3_SQL, op3_license
from umbra.llm.op4_classifier import op4_classifier
from umbra.llm.op5_secrets import op5_secrets
from umbra.llm.op6_quality import OP6_SQL, op6_quality
from umbra.llm.op7_chat import OP7_SQL, op7_chat
from umbra.llm.op8_decontaminate import OP8_SQL, op8_decontaminate
from umbra.llm.op9_html import op9_html
from umbra.llm.op10_mix import OP10_SQL, op10_mix

QUERIES = {
    "op1_lm": op1_lm,
    "op2_simhash": op2_simhash,
    "op3_license": op3_license,
    "op4_classifier": op4_classifier,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_html": op9_html,
    "op10_mix": op10_mix,
}

ORACLES = {"op3_license": OP3_SQL, "op6_quality": OP6_SQL, "op7_chat": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_mix": OP10_SQL}
