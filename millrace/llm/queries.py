"""Registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from millrace.llm import archives, centroids, importance, url_filter
from millrace.llm.archives import op3_archive
from millrace.llm.bpe import op5_bpe
from millrace.llm.centroids import op12_centroids
from millrace.llm.importance import op13_importance
from millrace.llm.langid import op8_langid
from millrace.llm.media import op1_media
from millrace.llm.pseudo_likelihood import op10_pseudo_likelihood
from millrace.llm.pu_quality import op4_quality
from millrace.llm.simhash import op9_simhash
from millrace.llm.spaced_seeds import op2_decontaminate
from millrace.llm.token_counts import op11_token_counts
from millrace.llm.toxicity import op6_toxicity
from millrace.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_media": op1_media,
    "op2_decontaminate": op2_decontaminate,
    "op3_archive": op3_archive,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_token_counts": op11_token_counts,
    "op12_centroids": op12_centroids,
    "op13_importance": op13_importance,
}
#: The others are tested against brute-force versions, exact round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op3_archive": archives.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_importance": importance.ORACLE,
}
