"""The registered queries of this folder and their SQL twins."""

from parlance.llm import (
    byte_bpe, decontamination, divergence, embeddings, jaccard, language_model, mixing, personal, ranked_search, secrets, suffixes, token_counts, toxicity,
)

QUERIES = {f.__name__: f for f in (
    secrets.op1_secret_scan,
    embeddings.op2_embedding_links,
    jaccard.op3_jaccard_join,
    byte_bpe.op4_byte_bpe,
    token_counts.op5_token_counts,
    personal.op6_personal_data,
    decontamination.op7_decontamination,
    language_model.op8_language_model,
    toxicity.op9_toxicity,
    suffixes.op10_suffix_dedup,
    ranked_search.op11_ranked_search,
    divergence.op12_source_divergence,
    mixing.op13_source_mix,
)}
ORACLES = {"op1_secret_scan": secrets.SQL, "op2_embedding_links": embeddings.SQL, "op7_decontamination": decontamination.SQL,
           "op11_ranked_search": ranked_search.SQL, "op12_source_divergence": divergence.SQL, "op13_source_mix": mixing.SQL}
