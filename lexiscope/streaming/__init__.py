"""Structured Streaming forms of the scoring and evaluation jobs.

The reference reads finite files only; these jobs run the same operators
when answer or text files keep arriving in a folder."""
