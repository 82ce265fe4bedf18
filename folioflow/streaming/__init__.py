"""Incremental conversion: new files of a folder as a stream."""
