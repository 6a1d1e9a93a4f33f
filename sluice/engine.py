"""The public interface: registered filters, in named indexes, and the rows that fulfil them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import FilterError
from sluice.functions.geo import convert_distance, convert_geopoint
from sluice.operators.conditions import Compiler
from sluice.operators.percolate import Prepared, percolate
from sluice.operators.values import quoted
from sluice.plans.language import Literal, Reader
from sluice.plans.normal import count, identifier, normal

#: What wrong options and arguments are told.
WRONG_ENGINE = 'Invalid configuration value for "regExpEngine". Supported: re2, js'
WRONG_SEED = "Invalid seed: expected a 32 bytes long Buffer"
WRONG_MAXIMUM = "Invalid maxConditions configuration: positive or nul integer expected"
WRONG_INDEX = 'Invalid "index" argument: must be a string'
TOO_COMPLEX = "Filter too complex: exceeds the configured maximum number of conditions (conditions: {n}, max: {most})"


@dataclass(frozen=True)
class NormalizedFilter:
    """A filter in normal form, with the id that filters of the same form and index share."""

    terms: tuple[tuple[Literal, ...], ...]
    id: str
    index: str | None
    source: str


class Percolator:
    """``max_conditions``: of a filter, 0 for no limit; ``regexp_engine``: re2 or js; ``seed``: 32 bytes, for ids that
    don't change; ``prune``: by_path counts tests for a field and for a value in it as one test when it looks for
    contradictions, sound doesn't."""

    convert_distance = staticmethod(convert_distance)
    convert_geopoint = staticmethod(convert_geopoint)

    def __init__(self, spark: SparkSession | None = None, max_conditions: int = 50, regexp_engine: str = "re2", seed: bytes | None = None, prune: str = "by_path") -> None:
        if regexp_engine not in ("re2", "js"):
            raise ValueError(WRONG_ENGINE)
        seed = os.urandom(32) if seed is None else seed
        if not isinstance(seed, (bytes, bytearray)) or len(seed) != 32:
            raise ValueError(WRONG_SEED)
        if isinstance(max_conditions, bool) or not isinstance(max_conditions, int) or max_conditions < 0:
            raise ValueError(WRONG_MAXIMUM)
        self.spark, self.max_conditions, self.seed, self.prune = spark, max_conditions, bytes(seed), prune
        self.reader, self.compiler = Reader(regexp_engine), Compiler(regexp_engine)
        self.indexes: dict[str | None, dict[str, NormalizedFilter]] = {None: {}}
        #: By index and kind of rows, the filters and what was made of them; kept until one is added or removed.
        self._prepared: dict[tuple, Prepared] = {}

    # filters

    def validate(self, given: Any) -> None:
        """Raises FilterError for a filter that breaks the language's rules."""
        self.reader.read(given)

    def normalize(self, given: Any, index: str | None = None) -> NormalizedFilter:
        if index is not None and not isinstance(index, str):
            raise ValueError(WRONG_INDEX)
        tree = self.reader.read(given)
        self._limit(tree)
        terms = normal(tree, by_path=self.prune == "by_path")
        return NormalizedFilter(terms, identifier(self.seed, terms, index), index, json.dumps(given, sort_keys=True))

    def _limit(self, tree: Any) -> None:
        n = count(tree)
        if self.max_conditions and n > self.max_conditions:
            raise FilterError(TOO_COMPLEX.format(n=n, most=self.max_conditions))
        stack = [tree]
        while stack:
            x = stack.pop()
            if not isinstance(x, Literal):
                stack += x.parts
            elif x.keyword == "select":
                self._limit(self.reader.read(x.args["query"]))

    def store(self, found: NormalizedFilter) -> str:
        if not isinstance(found, NormalizedFilter):
            raise ValueError("Invalid argument: not a normalized filter (use normalize to get one)")
        own = self.indexes.setdefault(found.index, {})
        if found.id not in own:
            self._changed(found.index)
        own[found.id] = found
        return found.id

    def register(self, given: Any, index: str | None = None) -> str:
        return self.store(self.normalize(given, index))

    def remove(self, filter_id: str, index: str | None = None) -> None:
        """Forgets a filter; a named index goes with its last one."""
        found = self.indexes.get(index)
        self._changed(index)
        if found is not None and found.pop(filter_id, None) is not None and not found and index is not None:
            del self.indexes[index]

    def _changed(self, index: str | None) -> None:
        self._prepared = {k: v for k, v in self._prepared.items() if k[0] != index}

    def get_filter_ids(self, index: str | None = None) -> list[str]:
        return list(self.indexes.get(index, {}))

    def get_indexes(self) -> list[str]:
        return ["(default)" if i is None else i for i in self.indexes]

    def has_filter_id(self, filter_id: str, index: str | None = None) -> bool:
        return filter_id in self.indexes.get(index, {})

    # rows

    def percolate(self, df: DataFrame, keys: list[str], *, index: str | None = None, doc: str | None = None, mode: str = "auto", names: dict[str, str] | None = None) -> DataFrame:
        """``keys`` and ``filter_id`` for each row and each filter of the index that it fulfils.

        Fields are the columns of ``df``, or those of its VARIANT column ``doc``. ``names``: what stands for an id. An
        unknown index has no filters. Works on streams, without state."""
        own = list(self.indexes.get(index, {}).values())
        ids = [(names or {}).get(f.id, f.id) for f in own]
        key = index, doc is not None, mode
        if key not in self._prepared:
            self._prepared[key] = Prepared.of([f.terms for f in own], doc is not None, mode)
        return percolate(df, doc, [], ids, keys, self.compiler, mode=mode, prepared=self._prepared[key])

    def test(self, document: dict, index: str | None = None) -> list[str]:
        """Ids of the filters that one document fulfils."""
        df = self._session().createDataFrame([(json.dumps(document),)], "json string").select(F.parse_json("json").alias("doc"))
        return sorted(r.filter_id for r in self.percolate(df, [], index=index, doc="doc").collect())

    def _session(self) -> SparkSession:
        return self.spark or SparkSession.builder.getOrCreate()

    # relations

    def filters(self) -> DataFrame:
        """index_name, filter_id, json: the registry as a frame, from which ``load`` restores it."""
        rows = [(i, f.id, f.source) for i, own in self.indexes.items() for f in own.values()]
        return self._session().createDataFrame(rows, "index_name string, filter_id string, json string")

    def conditions(self) -> DataFrame:
        """index_name, filter_id, term, keyword, field, args, negated: the filters in normal form."""
        rows = [(i, f.id, n, x.keyword, x.field, x.json, x.negated) for i, own in self.indexes.items() for f in own.values() for n, t in enumerate(f.terms) for x in t]
        return self._session().createDataFrame(rows, "index_name string, filter_id string, term int, keyword string, field string, args string, negated boolean")

    def load(self, filters: DataFrame) -> list[str]:
        """Registers the filters of a frame with json and perhaps index_name; returns their ids."""
        rows = filters.select("json", F.col("index_name") if "index_name" in filters.columns else F.lit(None).cast("string").alias("index_name")).collect()
        return [self.register(json.loads(r.json), r.index_name) for r in rows]


def document_column(df: DataFrame, columns: list[str] | None = None):
    """A VARIANT document of a row's columns; SQL nulls are missing keys. Timestamps and dates become strings."""
    return F.parse_json(F.to_json(F.struct(*[F.col(quoted(c)) for c in columns or df.columns])))


__all__ = ["FilterError", "NormalizedFilter", "Percolator", "document_column"]
