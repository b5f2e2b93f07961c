"""The training-data operators as named queries over whole tables, with SQL where it can express them."""

from . import chat, media, mixing, neardup, packing, quality, rules, sentencepiece, suffixes, warc

QUERIES = {
    "op1_minhash_dedup": neardup.op1_minhash_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_sentencepiece": sentencepiece.op3_sentencepiece,
    "op4_media_columns": media.op4_media_columns,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_packed_ids": packing.op6_packed_ids,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_warc": warc.op10_warc,
}

SQL = {"op2_chat_formatting": chat.OP2_SQL, "op10_warc": warc.OP10_SQL}
