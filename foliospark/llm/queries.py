"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from foliospark.llm import collocations, fim, hamming, linededup, media, mixing, neardup, packing, pieces, quality, secrets, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_hamming_topk": hamming.op2_hamming_topk,
    "op3_near_dedup": neardup.op3_near_dedup,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_iso_media": media.op6_iso_media,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_bm25_packing": packing.op8_bm25_packing,
    "op9_quality": quality.op9_quality,
    "op10_warc_index": warc.op10_warc_index,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_collocations": collocations.op12_collocations,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

ORACLE = {
    "op2_hamming_topk": hamming.SQL,
    "op3_near_dedup": neardup.SQL,
    "op4_source_mix": mixing.SQL,
    "op5_secret_scan": secrets.SQL,
    "op7_line_dedup": linededup.SQL,
    "op10_warc_index": warc.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_collocations": collocations.SQL,
}
