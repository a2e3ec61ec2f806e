"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; the queries that apply the
operators to the whole test tables are in :mod:`tilewright.llm.queries`.
"""
