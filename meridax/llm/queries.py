"""The queries of this subpackage for the driver's registry, and the SQL where it can express them."""

from __future__ import annotations

from meridax.llm.elias_fano import op2_token_ids
from meridax.llm.flac_media import op7_flac_media
from meridax.llm.language_id import op4_language_id
from meridax.llm.ngram_jaccard import op9_ngram_jaccard
from meridax.llm.oracles import QUALITY_SQL
from meridax.llm.packing import op6_best_fit_packing
from meridax.llm.pii_surrogates import op3_pii_surrogates
from meridax.llm.quality_rules import op10_quality_rules
from meridax.llm.source_mixing import op8_source_mixing
from meridax.llm.suffix_dedup import op1_suffix_dedup
from meridax.llm.warc_fixity import op5_merkle_fixity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_ids, op3_pii_surrogates, op4_language_id, op5_merkle_fixity, op6_best_fit_packing, op7_flac_media, op8_source_mixing, op9_ngram_jaccard, op10_quality_rules)}
ORACLES: dict[str, str] = {"op10_quality_rules": QUALITY_SQL}
