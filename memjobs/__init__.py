"""Spark jobs over agent memory: extraction, linking, retrieval, packing and upkeep as DataFrame operators."""
