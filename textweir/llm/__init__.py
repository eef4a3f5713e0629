"""Training-data operators: packing, near-duplicates, toxicity, decontamination and so on."""
