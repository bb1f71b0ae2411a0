"""The registered queries of this package, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from georisk.llm.bpe import op10_byte_bpe
from georisk.llm.decontaminate import op6_decontamination
from georisk.llm.language_id import op1_language_id
from georisk.llm.lexical import OP13_SQL, op13_lexical_search
from georisk.llm.packing import op11_packing
from georisk.llm.pii import SQL_KINDS, op8_pii
from georisk.llm.secret_scan import ACCESS, ASSIGN, HEX, op3_secret_scan
from georisk.llm.sharding import op4_sharding
from georisk.llm.simhash import op7_simhash
from georisk.llm.span_sql import spans_sql
from georisk.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from georisk.llm.topk import OP5_SQL, op5_exact_top_k
from georisk.llm.url_filter import OP9_SQL, op9_url_filter
from georisk.llm.whitening import op12_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_secret_scan": spans_sql([("assign", ASSIGN, "length(@v) >= 8", 2), ("access", ACCESS, "length(@v) >= 16", 0),
                                  ("hex", HEX, "length(@v) >= 32", 0)], by_kind=False),
    "op5_exact_top_k": OP5_SQL,
    "op8_pii": spans_sql(SQL_KINDS, by_kind=True),
    "op9_url_filter": OP9_SQL,
    "op13_lexical_search": OP13_SQL,
}
