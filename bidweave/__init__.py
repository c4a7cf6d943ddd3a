"""Bid analytics on Spark: ingest, decisions, carried state, text mining and product-keyword graphs as DataFrame plans."""
