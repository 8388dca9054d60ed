"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import decontam, jaccard, langid, mixing, pq, quality, secrets, sharding, tokens, warc
from tessella.llm.common import read


def queries() -> dict:
    return {
        "op1_sharding": lambda s, d: sharding.assign(read(s, d, "documents")),
        "op2_decontamination": lambda s, d: decontam.contaminated(read(s, d, "documents"), read(s, d, "benchmark")),
        "op3_jaccard_join": lambda s, d: jaccard.links(read(s, d, "documents")),
        "op4_token_codes": lambda s, d: tokens.token_table(read(s, d, "documents")),
        "op5_language_id": lambda s, d: langid.of_documents(read(s, d, "documents")),
        "op6_quality": lambda s, d: quality.classify(read(s, d, "documents"), read(s, d, "labels")),
        "op7_secrets": lambda s, d: secrets.find(read(s, d, "documents")),
        "op8_mixing": lambda s, d: mixing.mix(read(s, d, "documents")),
        "op9_embedding_pairs": lambda s, d: pq.links(read(s, d, "embeddings")),
        "op10_warc": lambda s, d: warc.derive(read(s, d, "pages")),
        "page_language": lambda s, d: langid.of_pages(read(s, d, "pages"), read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(), "op3_jaccard_join": jaccard.oracle(), "op8_mixing": mixing.oracle(), "op10_warc": warc.oracle()}
