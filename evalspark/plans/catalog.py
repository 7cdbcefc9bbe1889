"""Imports every module that registers queries."""

from evalspark.plans import queries_perf  # noqa: F401
from evalspark.plans import queries_prep  # noqa: F401
from evalspark.plans import queries_scoring  # noqa: F401
from evalspark.plans import queries_compare  # noqa: F401
from evalspark.plans import queries_runlog  # noqa: F401
from evalspark.plans import queries_guard  # noqa: F401
from evalspark.plans import queries_cache  # noqa: F401
from evalspark.plans import queries_retrieval  # noqa: F401
from evalspark.plans import queries_sweep  # noqa: F401
from evalspark.plans import queries_io  # noqa: F401
