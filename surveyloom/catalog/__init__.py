"""Registered queries over the driver tables, each beside its check SQL."""

from surveyloom.catalog import io, multivariate, profiles, statistics

_MODULES = (profiles, statistics, multivariate, io)


def all_queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def all_checks():
    return {name: sql for m in _MODULES for name, sql in m.CHECKS.items()}
