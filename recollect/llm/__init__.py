"""Operators for preparing large text corpora: packing, tokenising, filtering, de-duplication, scoring."""
