"""Places for what a run takes from services and models: map downloads, image tiles, masks of boxes.

A provider is a plain function of one region's values that gives rows; it runs
on executors, one call for each region, so no driver waits for a service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[..., list[tuple]]


def fetched(regions: DataFrame, provider: Provider, schema: str, empty_on_failure: bool = False) -> DataFrame:
    """Rows of ``schema`` that ``provider`` gives for every row of ``regions`` (its columns as keyword arguments).

    With ``empty_on_failure`` a region whose call fails has no rows, as water and
    building features have it; otherwise the failure ends the job, as it does
    for road graphs.  A call may be repeated when its executor is lost.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for region in part.to_dict("records"):
                try:
                    found = provider(**region)
                except Exception:
                    if not empty_on_failure:
                        raise
                    found = []
                yield pd.DataFrame(found, columns=names)

    return regions.mapInPandas(rows, schema)


def graph_of_regions(regions: DataFrame, nodes_of: Provider, edges_of: Provider) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all regions as one disjoint graph: ids are made unique by the region (region, id, x, y; region, edge_id, src, dst)."""
    from lanewright.operators.export import token

    nodes = fetched(regions, nodes_of, "region long, id long, x double, y double")
    edges = fetched(regions, edges_of, "region long, edge_id long, src long, dst long")
    own = lambda c: token("node", nodes["region"] if c == "id" else edges["region"], nodes["id"] if c == "id" else edges[c])
    return nodes.select("region", own("id").alias("id"), "x", "y"), edges.select("region", "edge_id", own("src").alias("src"), own("dst").alias("dst"))
