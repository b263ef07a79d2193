"""Sub-schemas of many queries over many schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.cypher import EXTRACTION, Graph, extract_from, extract_udf, extracted

#: Queries read together.
AT_ONCE = 2000


def extract_all(queries: DataFrame, schemas: DataFrame, key: str, schema_key: str = "schema_id", query: str = "query", ship_up_to: int = 8 << 20) -> DataFrame:
    """key with EXTRACTION's columns for each query whose schema is known.

    schemas: schema_key, labels array<string>, relations array<struct<source, type, target>>. Schemas of up to
    ship_up_to characters in all travel with the function, so that none is sent with each of its
    queries; beyond that, queries are joined to their schemas. A schema id that stands twice fails either way.
    """
    if repeated := schemas.groupBy(schema_key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"schema {repeated[0][0]!r} stands {repeated[0][1]} times")
    size = schemas.agg(F.sum(F.length(F.to_json(F.struct("labels", "relations"))))).first()[0] or 0
    if size > ship_up_to:
        joined = queries.join(schemas, schema_key)
        return joined.select(key, extract_udf(query, "labels", "relations").alias("x")).select(key, "x.*")
    few = schemas.collect()
    known = {r[schema_key]: Graph(r.labels, [(x.source, x.type, x.target) for x in r.relations]) for r in few if r[schema_key] is not None}
    types = to_arrow_schema(EXTRACTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Few rows at a time, as a query may use all of a schema; queries that stand there more than once are read once.
            for b in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                asked = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
                place = {x: i for i, x in enumerate(dict.fromkeys(x for x in asked if x[0] in known))}
                read = [extracted(extract_from(q or "", known[s])) for s, q in place]
                rows = pa.array([i for i, x in enumerate(asked) if x in place], pa.int64())
                values = pa.array([place[x] for x in asked if x in place], pa.int64())
                columns = [pa.array([r[i] for r in read], f.type).take(values) for i, f in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *columns], names=[key, *types.names])

    kind = f"{key} {dict(queries.dtypes)[key]}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EXTRACTION)
    return queries.select(key, schema_key, query).mapInArrow(run, kind)
