"""Cleaning, profiling and exploring tables on Spark."""
