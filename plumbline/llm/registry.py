"""Queries of this subpackage and, where SQL can express one, its DuckDB form."""

from plumbline.llm.chat import OP8_SQL, op8_chat_format
from plumbline.llm.decontaminate import op7_decontaminate
from plumbline.llm.gif import op4_media
from plumbline.llm.licenses import op9_license_scan
from plumbline.llm.lines import OP6_SQL, op6_line_dedup
from plumbline.llm.mixing import op1_mix
from plumbline.llm.neardup import op3_near_duplicates
from plumbline.llm.quality import op5_quality
from plumbline.llm.tokens import op10_token_blocks
from plumbline.llm.urls import op2_url_filter

QUERIES = {
    "op1_mix": op1_mix,
    "op2_url_filter": op2_url_filter,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_media": op4_media,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_license_scan": op9_license_scan,
    "op10_token_blocks": op10_token_blocks,
}

SQL: dict[str, str] = {
    "op6_line_dedup": OP6_SQL,
    "op8_chat_format": OP8_SQL,
}
