"""siftloom: generate-score-select data pipelines as Spark plans."""
