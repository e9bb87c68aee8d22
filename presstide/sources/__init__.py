"""Readers: delimited files, JSON documents, crawl indexes, record archives."""
