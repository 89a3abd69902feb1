"""Training-data pipeline operators: fingerprints, language id, URL filters,
substring and near-duplicate removal, tokenisation, quality, secrets, mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Each operator module has a general operator over any ``(id, text)`` frame and
a thin ``opN_<name>`` query that applies it to a whole driver table."""
