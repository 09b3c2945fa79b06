"""Every registered query with its oracle."""

from . import documents, events, more, retrieval, surface, text, wired

MODULES = (text, documents, retrieval, surface, events, more, wired)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
FLAGSHIP = "hybrid_pages"
