"""revlens: subscription-revenue analytics as Spark DataFrame plans.

Layers (each a subpackage):

* ``sources``   – raw table schemas, CSV/Parquet reads and overwrite sinks, and the
                  derivation of the nine raw shapes from the TPC-H-like test tables.
* ``functions`` – Column-level helpers (guarded rates, half-up rounding, calendar
                  attributes, elapsed time, 30-day buckets, movement classification).
* ``operators`` – DataFrame -> DataFrame building blocks (month spine, lag/lead,
                  percent change, exact median, unpivot/pivot, quality checks).
* ``plans``     – the composite models: staging, marts, dashboard queries and the
                  data-quality suite, wired through a lazy model registry.
* ``streaming`` – intentionally empty: the modelled workload is bounded batch only.
"""

from revlens.config import Filters, Horizon

__all__ = ["Filters", "Horizon"]
