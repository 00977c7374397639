"""caseloom: policy documents, observations and test cases as Spark jobs."""
