"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language_model import op2_lm_scoring
from .mixing import op4_mixing
from .near_dups import OP3_SQL, op3_ngram_jaccard
from .quality_model import op6_quality_classifier
from .quality_rules import OP5_SQL, op5_quality_rules
from .repeats import OP13_SQL, op13_repeats
from .secrets import op8_secret_scan
from .sharding import OP7_SQL, op7_sharding
from .tokens import op9_bpe, op10_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_lm_scoring, op3_ngram_jaccard, op4_mixing, op5_quality_rules, op6_quality_classifier, op7_sharding, op8_secret_scan, op9_bpe, op10_token_counts, op11_collocations, op12_token_alignment, op13_repeats)
}
SQL = {"op1_exact_dedup": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op5_quality_rules": OP5_SQL, "op7_sharding": OP7_SQL, "op11_collocations": OP11_SQL, "op13_repeats": OP13_SQL}
