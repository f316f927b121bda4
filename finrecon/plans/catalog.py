"""Imports every module that registers queries."""

from finrecon.operators import checks, contents, fields, filings, filters, guards, joins, lookahead, matching, plugs, pools, relevance, reports, retries, scalars, selections, statements, submissions, texts, windows  # noqa: F401
from finrecon.sources import grids, links, readers, sinks  # noqa: F401
from finrecon.streaming import feeds  # noqa: F401
