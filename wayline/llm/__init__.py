"""Operators for large training-text corpora, built on DataFrames of whole documents.

Every operator takes a DataFrame and returns a lazy DataFrame. ``queries`` in
``wayline.llm.entry`` binds each one to the tables of a data folder.
"""
