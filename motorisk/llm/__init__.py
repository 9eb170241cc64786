"""Training-data operators (chat formatting, mixing, deduplication, encoding,
filtering, packing, fingerprints). Nothing else in the library imports this
subpackage; ``motorisk.llm.queries`` registers its queries."""
