"""Readers and writers: raw event files, price files, keyed loads, result files."""
