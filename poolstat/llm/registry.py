"""Queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from . import chat, decontaminate, embeddings, language, licenses, manifest, minhash, mixing, pii, pipeline, search, sharding, toxicity, urls
from .common import table


def queries():
    return {
        "op1_embedding_dedup": lambda s, d: embeddings.near_vectors(table(s, d, "embeddings")),
        "op2_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.op3(table(s, d, "documents"), table(s, d, "labels")),
        "op4_language": lambda s, d: language.op4(table(s, d, "documents")),
        "op5_decontamination": lambda s, d: decontaminate.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_url_filter": lambda s, d: urls.judge(table(s, d, "pages")),
        "op7_licenses": lambda s, d: licenses.scan(table(s, d, "documents")),
        "op8_chat": lambda s, d: chat.format_chats(table(s, d, "conversations")),
        "op9_minhash_dedup": lambda s, d: minhash.near_duplicates(table(s, d, "documents"), width=3, percent=85),
        "op10_sharding": lambda s, d: sharding.op10(table(s, d, "documents")),
        "op11_manifest": lambda s, d: manifest.op11(table(s, d, "documents")),
        "op12_search": lambda s, d: search.search(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_pii": lambda s, d: pii.scan(table(s, d, "documents")),
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {"op11_manifest": manifest.sql(), "op12_search": search.SQL}
