"""Redundancy and coverage analytics of sequence collections, declared as Spark DataFrames."""
