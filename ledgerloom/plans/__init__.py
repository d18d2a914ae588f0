"""All queries of the library's own operators, and their DuckDB twins."""

from . import bank, correction, documents, files, lines, portfolio, scalars, streams, textjobs

MODULES = [scalars, lines, correction, bank, portfolio, documents, textjobs, files, streams]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
