"""Queries opN_<name> of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, media, near_dup, pitman_yor, quality, sharding, substring, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_media": media.op2_media,
    "op3_pitman_yor": pitman_yor.op3_pitman_yor,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_substring": substring.op6_substring,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_hilbert": sharding.op9_hilbert,
    "op10_chat": chat.op10_chat,
}
ORACLE_SQL = {
    "op6_substring": substring.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op10_chat": chat.ORACLE,
}
