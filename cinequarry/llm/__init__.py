"""Operators of a training-data pipeline: WARC capture assembly, licence
sentences, token-id shards, URL and document quality models, line and document
near-dedup, nearest neighbours, packing and mixing.

Nothing outside this subpackage imports it.
"""
