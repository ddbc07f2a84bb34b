"""Imports every module that registers queries."""

from lodemill.plans import code, commits, corpus, dataset, evaluation, posture, ranking, scalars, texts, topics  # noqa: F401
