"""Operators of a training-data pipeline over a ``documents`` table (doc_id, text, lang, source, ...).

Each module holds one operator with a general interface (texts, spans, files, models) and reads nothing but the
DataFrames it is given; ``queries.py`` registers one thin query per operator.
"""
