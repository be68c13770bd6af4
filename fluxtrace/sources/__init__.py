"""Readers and writers: tables with declared schemas, file discovery, acquisition metadata and raw movies."""
