"""Queries of the operators and their SQL."""

from __future__ import annotations

from parchmint.llm.bpe import op3_bpe
from parchmint.llm.conversations import ORACLE_OP13, op13_conversations
from parchmint.llm.embeddings import op6_embeddings
from parchmint.llm.hardneg import ORACLE_OP12, op12_hardneg
from parchmint.llm.jaccard import op9_jaccard
from parchmint.llm.langid import op1_langid
from parchmint.llm.licenses import op2_licenses
from parchmint.llm.linededup import ORACLE_OP4, op4_linededup
from parchmint.llm.minhash import ORACLE_NEAR_COPIES, near_copies, op5_minhash
from parchmint.llm.mixing import op7_mixing
from parchmint.llm.pii import op8_pii
from parchmint.llm.urlfilter import op10_urlfilter
from parchmint.llm.warc import ORACLE_OP11, op11_warc

QUERIES = {
    "op1_langid": op1_langid,
    "op2_licenses": op2_licenses,
    "op3_bpe": op3_bpe,
    "op4_linededup": op4_linededup,
    "op5_minhash": op5_minhash,
    "op6_embeddings": op6_embeddings,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_jaccard": op9_jaccard,
    "op10_urlfilter": op10_urlfilter,
    "op11_warc": op11_warc,
    "op12_hardneg": op12_hardneg,
    "op13_conversations": op13_conversations,
    "near_copies": near_copies,
}
ORACLES = {"op4_linededup": ORACLE_OP4, "op11_warc": ORACLE_OP11, "op12_hardneg": ORACLE_OP12, "op13_conversations": ORACLE_OP13, "near_copies": ORACLE_NEAR_COPIES}
