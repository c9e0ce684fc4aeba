"""Operators of a training-data pipeline (toxicity, near duplicates, repeated
passages, decontamination, packing, quality, licences, token files, WARC).

Nothing outside this folder imports it; ``queries.py`` registers one query
per operator and ``__spark_entry__.py`` adds them when the folder exists.
"""
