"""Spark jobs that remove personal data from large tables of text and measure how well it was removed."""
