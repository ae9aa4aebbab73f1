"""Outline of a document: blocks, heading candidates, contents regions, trees, paths.

Everything here works on one document at a time and is pure, so the Spark side
maps it over documents without a shuffle.
"""
