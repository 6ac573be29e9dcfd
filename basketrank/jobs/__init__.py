"""Whole runs: each module has functions to call and a command line."""
