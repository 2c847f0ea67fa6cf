"""Readers and writers: vector cache, raw channel files, manifests, matrices, runs."""
