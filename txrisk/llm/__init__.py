"""Training-data operators: fingerprints, classifiers, de-duplication, PII, BPE, decontamination, language ID.

Every operator takes a DataFrame plus column names and returns a DataFrame. The
registered queries (``queries.py``) apply them to the ``documents`` table.
Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
