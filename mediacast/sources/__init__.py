"""Readers and writers: platform exports, metadata, predictions, parameter store, decisions."""
