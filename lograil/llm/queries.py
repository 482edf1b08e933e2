"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontaminate import OP3_SQL, op3_decontaminate
from .line_dedup import op1_line_dedup
from .near_dedup import op4_near_dedup
from .quality import op10_quality
from .secrets import op2_secret_scan
from .substring_dedup import op7_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .transport_stream import OP8_SQL, op8_transport_stream
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe": op6_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_transport_stream": op8_transport_stream,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op8_transport_stream": OP8_SQL,
    "op9_warc": OP9_SQL,
}
