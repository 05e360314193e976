"""All queries of the engine and their SQL twins, gathered from the plan modules."""

from . import documents, evaluation, files, layout, ranking, reports, review, streams, tables

MODULES = (documents, layout, ranking, evaluation, review, reports, files, tables, streams)
QUERIES: dict = {}
ORACLES: dict = {}
#: Not registered: queries over cases of their own, with their twins; the tests run them.
FIXED: dict = {}
FIXED_ORACLES: dict = {}
for module in MODULES:
    own = getattr(module, "FIXED", {})
    QUERIES |= module.QUERIES
    FIXED |= own
    ORACLES |= {name: sql for name, sql in module.ORACLES.items() if name not in own}
    FIXED_ORACLES |= {name: sql for name, sql in module.ORACLES.items() if name in own}
