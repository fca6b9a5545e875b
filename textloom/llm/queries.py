"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, licenses, minhash_dedup, packing, pii, quality, secrets, substring_dedup, topk

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontamination,
        substring_dedup.op2_substring_dedup,
        secrets.op3_secret_scan,
        licenses.op4_license_scan,
        quality.op5_quality_classifier,
        packing.op6_packing,
        topk.op7_topk_search,
        pii.op8_pii,
        minhash_dedup.op9_minhash_dedup,
        chat.op10_chat_formatting,
    )
}

#: The other operators are compared with brute force in the tests.
SQL = {"op2_substring_dedup": substring_dedup.SQL, "op7_topk_search": topk.SQL, "op9_minhash_dedup": minhash_dedup.SQL, "op10_chat_formatting": chat.SQL}
