"""The registered queries of the llm operators, one for each."""

from .bpe_transducer import op7_bpe_transducer
from .crf import op6_crf_toxicity
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .feistel_shards import op10_feistel_shards
from .huffman_ids import op9_huffman_ids
from .imatch import op3_imatch
from .minhash import op8_minhash_icws
from .packing import op1_best_fit_packing
from .pseudo_lm import op4_pseudo_likelihood
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_imatch": op3_imatch,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_warc": op5_warc,
    "op6_crf_toxicity": op6_crf_toxicity,
    "op7_bpe_transducer": op7_bpe_transducer,
    "op8_minhash_icws": op8_minhash_icws,
    "op9_huffman_ids": op9_huffman_ids,
    "op10_feistel_shards": op10_feistel_shards,
}

#: The others are not expressible in SQL; tests/llm holds them against brute force, round trips or held-out labels.
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op5_warc": OP5_SQL}
