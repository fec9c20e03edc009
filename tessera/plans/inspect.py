"""What a stored graph holds.  python -m tessera.plans.inspect path [property ...]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.plans.graph import PropertyGraph
from tessera.sources.store import GraphStore


def report(spark: SparkSession, path: str, *keys: str) -> list[str]:
    """Counts, the commonest kinds of edges, and vertices by each property.  The log is not replayed."""
    g = GraphStore(spark, path).snapshot()
    s = g.stats().first()
    out = [f"vertices {s['n_vertices']}, edges {s['n_edges']}, blocks {s['n_blocks']}"]
    if "props" in g.vertices.columns and dict(g.vertices.dtypes)["props"] == "string":  # stored properties are JSON text
        v = g.vertices.select("id", *[F.get_json_object("props", f"$['{k}']").alias(k) for k in keys])
        g = PropertyGraph(v, g.edges)
    for key in keys:
        for r in g.group_counts(key).orderBy(F.desc("n"), key).limit(20).collect():
            out.append(f"{key} {r[key]}: {r['n']}")
    return out


if __name__ == "__main__":
    print("\n".join(report(SparkSession.builder.getOrCreate(), sys.argv[1], *sys.argv[2:])))
