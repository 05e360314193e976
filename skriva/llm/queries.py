"""The opN queries and the SQL that checks them, where SQL can express them."""

from .bpe import op1_byte_bpe
from .centroids import op11_annulus_clusters
from .decontaminate import op6_decontaminate
from .linededup import op12_line_dedup
from .lmscore import op7_lm_score
from .merkle import op13_merkle_manifest
from .neardup import op3_minhash_neardup
from .oracles import ORACLES  # noqa: F401
from .packing import op2_pack_tokens
from .pii import op4_pii_pseudonyms
from .quality import op5_quality_rules
from .repeats import op10_repeats
from .urlfilter import op9_url_filter
from .wrapper import op8_html_wrapper

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_pack_tokens, op3_minhash_neardup, op4_pii_pseudonyms, op5_quality_rules, op6_decontaminate, op7_lm_score,
        op8_html_wrapper, op9_url_filter, op10_repeats, op11_annulus_clusters, op12_line_dedup, op13_merkle_manifest,
    )
}
