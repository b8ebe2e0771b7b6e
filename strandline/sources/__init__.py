"""Readers of files and projections of native records onto envelopes and claims."""
