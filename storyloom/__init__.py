"""Story-infilling corpus engine: corpus preparation, tokenisation and count-based evaluation as Spark jobs."""
