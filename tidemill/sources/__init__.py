"""Readers and writers of files, tables and services."""
