"""Record and text analytics as composable DataFrame functions on Spark."""
