"""Training-data operators: sampling, tokens, shards, fingerprints, filters, joins, HTML and WARC."""
