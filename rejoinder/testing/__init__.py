"""Inputs made from the given tables, and a stand-in for a language model: for tests and trial runs, not for use."""
