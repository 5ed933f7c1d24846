"""The subpackage's registered queries and the SQL of those that SQL can express."""

from . import bpe, extraction, flac, licenses, minhash, negatives, packing, pii, repair, secrets, spelling, topk, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_minhash": minhash.op2_minhash,
    "op3_token_output": repair.op3_token_output,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_licenses": licenses.op6_licenses,
    "op7_topk": topk.op7_topk,
    "op8_media": flac.op8_media,
    "op9_bpe": bpe.op9_bpe,
    "op10_secrets": secrets.op10_secrets,
    "op11_spelling": spelling.op11_spelling,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_extraction": extraction.op13_extraction,
}
ORACLE_SQL = {"op2_minhash": minhash.OP2_SQL, "op7_topk": topk.OP7_SQL, "op11_spelling": spelling.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL}
