"""The registered queries of this subpackage and their check SQL."""

from . import chat_rotation, collocations, fill_middle, html_layout, iblt, minhash_dedup, mixing, onebit_search, packing, quality_fm, repeats, secret_scan, url_filter

QUERIES = {
    "op1_quality": quality_fm.op1,
    "op2_html_text": html_layout.op2,
    "op3_pack": packing.op3,
    "op4_rotate_chats": chat_rotation.op4,
    "op5_mix_sources": mixing.op5,
    "op6_secrets": secret_scan.op6,
    "op7_nearest": onebit_search.op7,
    "op8_url_filter": url_filter.op8,
    "op9_near_dedup": minhash_dedup.op9,
    "op10_fingerprints": iblt.op10,
    "op11_repeats": repeats.op11,
    "op12_collocations": collocations.op12,
    "op13_fill_middle": fill_middle.op13,
}

CHECK_SQL = {
    "op4_rotate_chats": chat_rotation.OP4_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op11_repeats": repeats.op11,
    "op12_collocations": collocations.OP12_SQL,
}
