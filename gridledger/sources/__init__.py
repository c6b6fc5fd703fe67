"""Readers and writers: files, envelopes, documents, keyed snapshots."""
