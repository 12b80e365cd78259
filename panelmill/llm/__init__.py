"""Training-data operators: formatting, packing, scans, classification, deduplication, sharding and decontamination."""
