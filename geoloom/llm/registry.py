"""The queries of this subpackage."""

from __future__ import annotations

from . import oracle
from .licenses import op7_license_scan
from .media import op9_chunked_media
from .mixing import op5_pivotal_mix
from .neighbours import op6_cap_filters
from .ngramjoin import op4_adaptive_prefix_join
from .packing import op10_slack_packing
from .pseudonyms import op2_feistel_pseudonyms
from .quality import op1_importance_resampling
from .sharding import op3_lpt_shards
from .tokencount import op8_bpe_counts

QUERIES = {q.__name__: q for q in (op1_importance_resampling, op2_feistel_pseudonyms, op3_lpt_shards, op4_adaptive_prefix_join, op5_pivotal_mix, op6_cap_filters, op7_license_scan, op8_bpe_counts, op9_chunked_media, op10_slack_packing)}
ORACLE: dict[str, str] = {"op3_lpt_shards": oracle.LPT, "op4_adaptive_prefix_join": oracle.JACCARD, "op5_pivotal_mix": oracle.MIX, "op6_cap_filters": oracle.COSINE, "op7_license_scan": oracle.LICENSES, "op9_chunked_media": oracle.MEDIA}
