"""Part of lexiweave: text vectorisation and classification on Spark."""
