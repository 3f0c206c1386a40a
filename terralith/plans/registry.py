"""All registered queries of the library's own operators, with SQL where SQL can express them."""

from . import queries_core, queries_more, queries_observed, queries_rest, queries_space, queries_surface

_MODULES = (queries_core, queries_space, queries_more, queries_rest, queries_surface, queries_observed)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
