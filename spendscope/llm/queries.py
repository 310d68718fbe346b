"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from spendscope.llm import conversations, decontamination, filter_audit, pivot_search, sql, warc_zip
from spendscope.llm.bpe_automaton import op1_bpe_automaton
from spendscope.llm.byte_cnn import op6_byte_cnn
from spendscope.llm.nbsvm import op7_nbsvm
from spendscope.llm.near_dedup import op5_bayes_minhash
from spendscope.llm.order_minhash import op3_order_minhash
from spendscope.llm.packing import op4_binary_packing
from spendscope.llm.suffix_dedup import op10_suffix_dedup
from spendscope.llm.window_dedup import op8_window_dedup

LLM_QUERIES = {
    "op1_bpe_automaton": op1_bpe_automaton,
    "op2_warc_zip": warc_zip.op2_warc_zip,
    "op3_order_minhash": op3_order_minhash,
    "op4_binary_packing": op4_binary_packing,
    "op5_bayes_minhash": op5_bayes_minhash,
    "op6_byte_cnn": op6_byte_cnn,
    "op7_nbsvm": op7_nbsvm,
    "op8_window_dedup": op8_window_dedup,
    "op9_pivot_search": pivot_search.op9_pivot_search,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_suffix_decontamination": decontamination.op11_suffix_decontamination,
    "op12_rank_viterbi": conversations.op12_rank_viterbi,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
LLM_SQL = {
    "op2_warc_zip": warc_zip.SQL,
    "op5_bayes_minhash": sql.NEAR_DUPLICATES,
    "op8_window_dedup": sql.REPEATED_WINDOWS,
    "op9_pivot_search": pivot_search.SQL,
    "op11_suffix_decontamination": decontamination.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
