"""Operators on put logs: each takes and returns DataFrames.

A put log has the columns seq (unique long), key (64 hex digits) and value;
some operators also read length or op.
"""
