"""Training-corpus operators: archives, deduplication, scans, packing and scoring."""
