"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from . import audit, bpe, chat, decontaminate, langid, neardup, pii, secrets, topk, toxicity, urls, warc, whiten

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_preference": chat.op3_preference,
    "op4_url_filter": urls.op4_url_filter,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language_id": langid.op6_language_id,
    "op7_secrets": secrets.op7_secrets,
    "op8_topk": topk.op8_topk,
    "op9_neardup": neardup.op9_neardup,
    "op10_pii": pii.op10_pii,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_whitening": whiten.op13_whitening,
}
ORACLES = {"op1_warc": warc.ORACLE, "op3_preference": chat.ORACLE, "op4_url_filter": urls.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op8_topk": topk.ORACLE, "op11_filter_audit": audit.ORACLE}
