"""All queries over the reference's own operators, gathered from the modules of this folder."""

from __future__ import annotations

from weftgraph.catalog import Catalog
from weftgraph.plans import corpus, entities, events, graphs, hybrids, kept, layouts, messages, policies, relational, routes, schedules

CATALOG = Catalog()
for module in (relational, events, graphs, corpus, entities, messages, kept, routes, hybrids, schedules, layouts, policies):
    for name, one in module.CATALOG.items():
        CATALOG.add(name, one.sql, one.covers)(one.run)
