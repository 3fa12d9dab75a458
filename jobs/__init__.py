"""Runnable jobs: ``python -m jobs.term_matrix`` and ``python -m jobs.drain_channel``, each with a config file beside it."""
