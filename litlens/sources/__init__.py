"""Readers and writers of the evaluation's file formats."""
