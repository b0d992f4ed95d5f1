"""The queries of this subpackage and their SQL."""

from . import bpe, chat, decontam, hamming, hardneg, jaccard, quality, secrets, spelling, tokenbin, topk, urls, warc

QUERIES = {
    "op1_token_planes": tokenbin.op1_token_planes,
    "op2_chat": chat.op2_chat,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_bpe": bpe.op6_bpe,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_url_lists": urls.op9_url_lists,
    "op10_warc": warc.op10_warc,
    "op11_minhash_hamming": hamming.op11_minhash_hamming,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLE_SQL = {
    "op2_chat": chat.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op8_ngram_jaccard": jaccard.ORACLE,
    "op9_url_lists": urls.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_minhash_hamming": hamming.ORACLE,
    "op12_hard_negatives": hardneg.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
