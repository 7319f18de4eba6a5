"""Readers: files of many kinds into long tables of cells, paragraphs, vectors and metadata.

All start from Spark's binaryFile source, so any Hadoop file system serves; a
file is parsed by one task, files are spread over all.
"""
