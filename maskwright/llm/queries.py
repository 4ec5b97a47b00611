"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, langid, minhash, repeats, secrets, topk, toxicity, warc

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_bpe": bpe.op2_bpe,
    "op3_langid": langid.op3_langid,
    "op4_chat": chat.op4_chat,
    "op5_minhash": minhash.op5_minhash,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secrets": secrets.op8_secrets,
    "op9_warc": warc.op9_warc,
    "op10_topk": topk.op10_topk,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op4_chat": chat.OP4_SQL, "op9_warc": warc.OP9_SQL, "op10_topk": topk.OP10_SQL}
