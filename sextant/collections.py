"""Collections: named tables of vectors with data and metadata, and what can be done with them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.arrow import shared_dir
from sextant.operators import ann, embed, knn, quantize
from sextant.sources.tables import rows_from_json

SCHEMA = "id bigint, vector array<float>, data string, metadata string"


class Collections:
    """The tables of a database."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database, self.indexes = spark, database, {}

    def _name(self, name: str) -> str:
        if not re.fullmatch(r"\w{1,63}", name):
            raise ValueError(f"not a name: {name!r}")
        return f"`{self.database}`.`{name}`"

    def list(self) -> DataFrame:
        rows = [(t.name, [c.name for c in self.spark.catalog.listColumns(f"{self.database}.{t.name}")]) for t in self.spark.catalog.listTables(self.database) if not t.isTemporary]
        return self.spark.createDataFrame(rows, "name string, columns array<string>")

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name))

    def create(self, name: str, schema: str = SCHEMA) -> None:
        self.spark.createDataFrame([], schema).write.saveAsTable(self._name(name))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self._name(name)}")
        self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name}

    def insert(self, name: str, rows: Sequence[dict]) -> int:
        """Rows of JSON objects; columns that they lack are null. Strings are stored as they are."""
        table = self.get(name)
        new = rows_from_json(self.spark, [{c: r.get(c) for c in table.columns} for r in rows if isinstance(r, dict)], table.schema.simpleString())
        new.write.mode("append").saveAsTable(self._name(name))
        return len(rows)

    def search(self, name: str, query: Sequence[float] | str, k: int = 10, metric: str = "l2sq", vector: str = "vector", id: str = "id", select: Sequence[str] | None = None, model: str = "hash/64", runtime: str = "hash") -> DataFrame:
        """The nearest rows to a vector, or to the embedding of a text; by an index on the column if there is one."""
        q = self.spark.range(1).select(embed.llm_embedding(F.lit(query), model, runtime).alias("v")).first().v if isinstance(query, str) else query
        index = next((i for t, i in self.indexes.values() if t == name and i.vector == vector and i.options.metric == metric), None)
        found = ann.search(index, q, k) if index else knn.knn(self.get(name), q, k, metric, vector, id)
        return found.select(*select, "dist") if select else found

    def create_index(self, name: str, index: str | None = None, vector: str = "vector", id: str = "id", **options) -> str:
        """Without a name, the index is called after the table and column."""
        index = index or f"{name}_{vector}_idx"
        self.indexes[index] = (name, ann.build(self.get(name), f"{shared_dir(self.spark)}/{index}", ann.Options(**options), id, vector))
        return index

    def drop_index(self, index: str) -> None:
        del self.indexes[index]

    def quantize(self, name: str, vector: str = "vector", clusters: int = 256, subvectors: int = 16, metric: str = "l2sq") -> str:
        """Adds ``<vector>_pq``, in place of one that is there."""
        if f"{vector}_pq" in self.get(name).columns:
            quantize.drop_quantization(self.spark, name, vector)
        return quantize.quantize_table(self.spark, name, vector, clusters, subvectors, metric)
