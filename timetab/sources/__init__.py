"""Readers and writers: tables, dataset bundles, run reports, predictions."""
