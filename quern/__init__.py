"""quern: retrieval, grounding, evaluation and corpus curation on Spark DataFrames."""
