"""The queries of this subpackage and their SQL, by name."""

from parlux.llm.chat import OP3_SQL, op3_chat
from parlux.llm.codes import OP13_SQL, op13_codes
from parlux.llm.decontam import OP12_SQL, op12_decontam
from parlux.llm.mixing import op1_mixing
from parlux.llm.neardup import op6_neardup
from parlux.llm.packing import op4_packing
from parlux.llm.pii import op9_pii
from parlux.llm.quality import OP5_SQL, op5_quality
from parlux.llm.records import op10_records
from parlux.llm.token_counts import op7_token_counts
from parlux.llm.topk import OP2_SQL, op2_topk
from parlux.llm.trie import OP11_SQL, op11_trie
from parlux.llm.url_filter import OP8_SQL, op8_url_filter

QUERIES = {f.__name__: f for f in (op1_mixing, op2_topk, op3_chat, op4_packing, op5_quality, op6_neardup, op7_token_counts, op8_url_filter, op9_pii, op10_records, op11_trie, op12_decontam, op13_codes)}
ORACLE_SQL = {"op2_topk": OP2_SQL, "op3_chat": OP3_SQL, "op5_quality": OP5_SQL, "op8_url_filter": OP8_SQL, "op11_trie": OP11_SQL, "op12_decontam": OP12_SQL, "op13_codes": OP13_SQL}
