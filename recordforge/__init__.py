"""Spark jobs for generating, checking and analyzing large sets of records."""
