"""Queries of the corpus operators, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from sondage.llm import anchors, decontam, embed, fim, langid, lifetimes, minhash, mixing, pii, quality, suffix, tokens, warc

QUERIES = {
    "op1_warc_segments": warc.query,
    "op2_token_counts": tokens.query,
    "op3_near_duplicates": minhash.query,
    "op4_mix_sources": mixing.query,
    "op5_personal_data": pii.query,
    "op6_embedding_links": embed.query,
    "op7_language": langid.query,
    "op8_repeated_strings": suffix.query,
    "op9_decontaminate": decontam.query,
    "op10_quality_trees": quality.query,
    "op11_batch_lifetimes": lifetimes.query,
    "op12_fill_in_middle": fim.query,
    "op13_repeated_words": anchors.query,
}

SQL = {
    "op1_warc_segments": warc.SQL,
    "op6_embedding_links": embed.SQL,
    "op4_mix_sources": mixing.SQL,
    "op9_decontaminate": decontam.SQL,
    "op11_batch_lifetimes": lifetimes.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_repeated_words": anchors.SQL,
}
