"""The registered queries of the text operators. Those without SQL need a tokenizer, a trained model or XXH64."""

from __future__ import annotations

from slotline.llm.best_fit import op4_best_fit
from slotline.llm.byte_bpe import op1_byte_bpe
from slotline.llm.collocations import SQL as COLLOCATIONS
from slotline.llm.collocations import op12_collocations
from slotline.llm.fill_middle import SQL as FILL_MIDDLE
from slotline.llm.fill_middle import op11_fill_middle
from slotline.llm.language_crf import op7_language_crf
from slotline.llm.licence_scan import op13_licence_scan
from slotline.llm.lm_score import op2_lm_score
from slotline.llm.near_copies import op6_simhash
from slotline.llm.order_minhash import op10_order_minhash
from slotline.llm.private_data import op9_private_data
from slotline.llm.quality_rank import op3_quality_rank
from slotline.llm.quality_rules import op5_quality_rules
from slotline.llm.secret_scan import op8_secret_scan

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_lm_score,
        op3_quality_rank,
        op4_best_fit,
        op5_quality_rules,
        op6_simhash,
        op7_language_crf,
        op8_secret_scan,
        op9_private_data,
        op10_order_minhash,
        op11_fill_middle,
        op12_collocations,
        op13_licence_scan,
    )
}
ORACLE: dict[str, str] = {"op11_fill_middle": FILL_MIDDLE, "op12_collocations": COLLOCATIONS}
