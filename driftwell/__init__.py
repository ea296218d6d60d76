"""driftwell: machine-learning analytics on event and tabular data, written for PySpark."""
