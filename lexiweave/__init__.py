"""Text vectorisation and classification on Spark."""
