"""Training-data operators: fixity, dedup, extraction, packing, fingerprints,
language, search, sharding, mixing and toxicity.  Nothing else in the library
imports this subpackage."""
