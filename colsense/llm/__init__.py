"""Training-data operators (extraction, deduplication, decontamination,
packing, sharding, scoring).  Nothing outside this subpackage imports it."""
