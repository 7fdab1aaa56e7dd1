"""A Spark-native transactional table engine with a typed, lazily evaluated query builder."""

from .functions.predicate import P, Predicate
from .functions.schema import TableSchema, Uri
from .operators.query import Query
from .policies import Policies
from .sources.external import external
from .database import Database

__all__ = ["Database", "P", "Policies", "Predicate", "Query", "TableSchema", "Uri", "external"]
