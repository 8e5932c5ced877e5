"""tessera: learner and corpus analytics as composable Spark DataFrame functions."""
