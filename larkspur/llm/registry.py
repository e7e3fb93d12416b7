"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from larkspur.llm.chat_format import OP5_SQL, op5_chat_format
from larkspur.llm.decontaminate import op3_decontamination
from larkspur.llm.html_extract import op9_html_extraction
from larkspur.llm.language_id import op2_language_id
from larkspur.llm.license_scan import OP4_SQL, op4_license_scan
from larkspur.llm.mixing import op10_mixing
from larkspur.llm.simhash_dedup import op7_simhash_dedup
from larkspur.llm.spotsigs import OP6_SQL, op6_spotsigs
from larkspur.llm.token_counts import op1_token_counts
from larkspur.llm.warc import op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_language_id, op3_decontamination, op4_license_scan, op5_chat_format, op6_spotsigs, op7_simhash_dedup, op8_warc, op9_html_extraction, op10_mixing)
}

#: The others are learned, iterative, read files back or hash in a way that SQL can't say; tests/llm/ hold them against brute force.
ORACLE_SQL = {"op4_license_scan": OP4_SQL, "op5_chat_format": OP5_SQL, "op6_spotsigs": OP6_SQL}
