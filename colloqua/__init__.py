"""Colloqua: conversation-corpus analytics on Spark DataFrames."""
