"""The operators' registered queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordertide.llm import centroids, chat, decontam, html_text, lines, lm, minhash, packing, prefix_trie, quality, sharding, simhash, suffix
from ordertide.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_odd_sketch_dedup": lambda s, d: minhash.op1(read(s, d, "documents", "doc_id", "text")),
    "op2_chat_format": lambda s, d: chat.op2(read(s, d, "conversations")),
    "op3_pack_mixture": lambda s, d: packing.op3(read(s, d, "documents", "doc_id", "text", "source")),
    "op4_lattice_lm": lambda s, d: lm.op4(read(s, d, "documents", "doc_id", "text")),
    "op5_suffix_dedup": lambda s, d: suffix.op5(read(s, d, "documents", "doc_id", "text")),
    "op6_quality_lines": lambda s, d: quality.op6(read(s, d, "documents", "doc_id", "text", "source")),
    "op7_decontaminate": lambda s, d: decontam.op7(read(s, d, "documents", "doc_id", "text"), read(s, d, "benchmark")),
    "op8_fuzzy_lines": lambda s, d: lines.op8(read(s, d, "documents", "doc_id", "text")),
    "op9_rendezvous_shards": lambda s, d: sharding.op9(read(s, d, "documents", "doc_id", "text")),
    "op10_html_text": lambda s, d: html_text.op10(read(s, d, "pages")),
    "op11_prefix_trie": lambda s, d: prefix_trie.op11(read(s, d, "conversations", "conv_id", "turn", "role", "text")),
    "op12_elkan_clusters": centroids.op12,
    "op13_simhash_trie": lambda s, d: simhash.op13(read(s, d, "documents", "doc_id", "text")),
}
SQL: dict[str, str] = {"op2_chat_format": chat.OP2_SQL, "op6_quality_lines": quality.OP6_SQL, "op7_decontaminate": decontam.OP7_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_elkan_clusters": centroids.OP12_SQL}
