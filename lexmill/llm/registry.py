"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

from lexmill.llm import collocations, decontaminate, licenses, media, mixing, near_dedup, pieces, pii, prefix_trie, sstable, token_counts, toxicity, warc

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_media_columns": media.op2_media_columns,
    "op3_warc_derivatives": warc.op3_warc_derivatives,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_personal_data": pii.op5_personal_data,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_mix_to_weights": mixing.op8_mix_to_weights,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sstable": sstable.op10_sstable,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_collocations": collocations.op12_collocations,
    "op13_sentencepieces": pieces.op13_sentencepieces,
}

SQL = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op3_warc_derivatives": warc.OP3_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op8_mix_to_weights": mixing.OP8_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
