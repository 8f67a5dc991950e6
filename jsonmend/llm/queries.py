"""The registered queries of this subpackage and their DuckDB oracles."""

from jsonmend.llm import bpe, chat, exact, language, mixing, neardup, neighbours, quality, secrets, sharding

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_secrets": secrets.op2_secrets,
    "op3_language": language.op3_language,
    "op4_near": neardup.op4_near,
    "op5_nearest": neighbours.op5_nearest,
    "op6_mix": mixing.op6_mix,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_chat": chat.op9_chat,
    "op10_exact": exact.op10_exact,
}

ORACLES = {
    "op1_shard": sharding.ORACLE,
    "op4_near": neardup.ORACLE,
    "op9_chat": chat.ORACLE,
    "op10_exact": exact.ORACLE,
}
