"""Streaming.

Graphs are sealed batches: no operator of this engine needs watermarks, event
windows or keyed state. Progress of jobs is what changes over time; see
``graphloom.engine.Engine``.
"""
