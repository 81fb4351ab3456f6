"""quillgrid: a corpus retrieval and evidence-checking engine expressed in Spark DataFrames."""
