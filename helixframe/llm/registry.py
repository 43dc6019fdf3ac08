"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.bpe import op1_bpe
from helixframe.llm.byte_bpe import op13_byte_bpe
from helixframe.llm.conversations import op12_conversation_repair
from helixframe.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from helixframe.llm.html_text import op8_html
from helixframe.llm.langid import op6_langid
from helixframe.llm.lexical import OP11_SQL, op11_lexical_search
from helixframe.llm.minhash import op9_minhash
from helixframe.llm.packing import op2_packing
from helixframe.llm.quality import op10_quality
from helixframe.llm.secrets import op7_secrets
from helixframe.llm.topk import OP4_SQL, op4_exact_topk
from helixframe.llm.toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_packing, op3_exact_dedup, op4_exact_topk, op5_toxicity, op6_langid, op7_secrets, op8_html, op9_minhash, op10_quality, op11_lexical_search,
        op12_conversation_repair, op13_byte_bpe,
    )
}
SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_exact_topk": OP4_SQL, "op11_lexical_search": OP11_SQL}
