"""Readers and writers of corpora, record outputs and metric tables."""
