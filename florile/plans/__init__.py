"""Registered queries over the tables, and the SQL that says what each returns."""

from . import acting, bulk, logs, matching, media, naming, outputs, saving, searching, summing, texts

_MODULES = (searching, summing, texts, naming, matching, logs, outputs, acting, media, saving, bulk)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
