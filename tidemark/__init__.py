"""tidemark: trade-feature analytics on Spark, with operators for training corpora in ``tidemark.llm``."""
