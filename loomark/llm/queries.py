"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from loomark.llm import audio, bpe, decontaminate, langid, line_dedup, pii, sharding, simhash, substrings, warc

QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_pii": pii.op2,
    "op3_bpe": bpe.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_audio": audio.op5,
    "op6_simhash": simhash.op6,
    "op7_warc": warc.op7,
    "op8_substrings": substrings.op8,
    "op9_langid": langid.op9,
    "op10_decontamination": decontaminate.op10,
}
ORACLE_SQL = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
}
