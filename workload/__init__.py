"""Registered queries over the given tables, with SQL that checks them."""


def _load():
    from . import queries_lists, queries_pages, queries_sites, registry  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
