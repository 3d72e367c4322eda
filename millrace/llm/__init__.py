"""Operators for building training corpora: media columns, decontamination, archives, quality and toxicity models,
byte-level BPE, URL verdicts, language ID, near-duplicate fingerprints and pseudo-likelihood scoring.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
