"""Spark-first analytics over corpora, link graphs and labelled text."""
