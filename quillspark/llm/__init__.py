"""Training-data operators: scans, packing, decontamination, extraction, quality, token counts, search, joins."""
