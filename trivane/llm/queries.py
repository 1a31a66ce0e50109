"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import OP5_SQL, op5_decontaminate
from .embeddings import OP1_SQL, op1_embedding_near_dedup
from .jaccard import OP8_SQL, op8_jaccard_join
from .licenses import op4_scan_licenses
from .mixing import op7_mix_sources
from .pii import op9_pii
from .quality import op6_quality
from .substrings import OP2_SQL, op2_substring_dedup
from .toxicity import op3_toxicity
from .warc import op10_warc_round_trip

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_scan_licenses": op4_scan_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_mix_sources": op7_mix_sources,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pii": op9_pii,
    "op10_warc_round_trip": op10_warc_round_trip,
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op10_warc_round_trip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first <> page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
}
