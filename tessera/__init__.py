"""A Spark-native query engine: a fluent API and a token language over DataFrames."""

from tessera.functions.fields import F, typed
from tessera.plans.policy import Policy
from tessera.plans.query import Query, from_collection
from tessera.plans.tokens import compile_predicate

__all__ = ["F", "Policy", "Query", "compile_predicate", "from_collection", "typed"]
