"""Training-data operators: dedup, packing, PII, URL and quality filters, HTML.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
