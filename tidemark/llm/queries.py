"""The thin queries of the ten operators, and DuckDB SQL for those that SQL can express."""

from .chat import OP6_SQL, op6_chat
from .dedup import OP2_SQL, op2_exact_dedup
from .langid import op8_langid
from .licenses import op7_licenses
from .mix import op1_mix
from .neardup import OP10_SQL, op10_near_dups
from .pack import op3_pack
from .pii import op5_pii
from .topk import OP9_SQL, op9_top_k
from .urls import op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix, op2_exact_dedup, op3_pack, op4_url_filter, op5_pii, op6_chat, op7_licenses, op8_langid, op9_top_k, op10_near_dups,
    )
}

SQL = {"op2_exact_dedup": OP2_SQL, "op6_chat": OP6_SQL, "op9_top_k": OP9_SQL, "op10_near_dups": OP10_SQL}
