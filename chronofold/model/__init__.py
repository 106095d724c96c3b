"""Training and scoring with Spark's own learners."""
