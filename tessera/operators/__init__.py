"""Relational, lexical, vector and store operators."""
