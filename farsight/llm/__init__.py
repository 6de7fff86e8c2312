"""Training-data operators: scoring, scanning, de-duplication, decontamination and packing of text corpora."""
