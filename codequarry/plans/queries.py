"""All registered queries of this library but the text operators', and their SQL."""

from __future__ import annotations

from . import bound, synth

_ALL = {**bound.QUERIES, **synth.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
