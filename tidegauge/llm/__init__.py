"""Operators that prepare text, page, conversation and vector tables for training language models."""
