"""Queries of the engine's own operators over the given tables, with their SQL."""

from driftline.plans import base, composed, documents, flow, jobs, places, polygons, relational, routing, rules, scoring, spatial, streams, temporal


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
