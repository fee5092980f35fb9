"""Micro-batches into the incremental build: an extension; the reference semantics are those of Engine.build."""
