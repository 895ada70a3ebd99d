"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op9_pigeonhole_edits
from .fingerprint import op2_multiset_hash
from .lines import OP11_SQL, op11_line_dedup
from .lm import op1_log_bilinear
from .packing import op4_pack_ffd
from .periods import op12_periodic_runs
from .quotes import OP8_SQL, op8_quote_links
from .secrets import op7_secret_links
from .sharding import op10_fixed_slots
from .simhash import op3_simhash_bitsliced
from .toxicity import op6_subsequence_svm
from .trie import OP13_SQL, op13_prefix_trie
from .warc import op5_warc_merge

QUERIES = {
    "op1_log_bilinear": op1_log_bilinear,
    "op2_multiset_hash": op2_multiset_hash,
    "op3_simhash_bitsliced": op3_simhash_bitsliced,
    "op4_pack_ffd": op4_pack_ffd,
    "op5_warc_merge": op5_warc_merge,
    "op6_subsequence_svm": op6_subsequence_svm,
    "op7_secret_links": op7_secret_links,
    "op8_quote_links": op8_quote_links,
    "op9_pigeonhole_edits": op9_pigeonhole_edits,
    "op10_fixed_slots": op10_fixed_slots,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op8_quote_links": OP8_SQL, "op11_line_dedup": OP11_SQL, "op13_prefix_trie": OP13_SQL}
