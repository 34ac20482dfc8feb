"""Forensic disk-image analytics on Spark: content identification, layout decoding, voting, search and corpus summaries."""
