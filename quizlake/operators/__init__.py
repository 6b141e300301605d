"""Relational operators: ranking, frame filters, question mining, clustering, tables."""
