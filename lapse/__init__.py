"""lapse — subscription retention analytics as Spark DataFrame operators.

Every public function takes DataFrames (and plain parameters) and returns a
lazy DataFrame; nothing row-level is collected to the driver.  Sub-packages:

- ``sources``    scans, adapters over the driver tables, sinks
- ``functions``  column expressions (dates, clipping, ratios, bucketing)
- ``operators``  population/labels, features, profiling, ranking, prep,
                 metrics, survival, calibration, decision layer, models
- ``plans``      named query plans (``queries()``) and their SQL oracles
- ``streaming``  incremental file ingest with Structured Streaming
"""

from lapse.params import Params, TEST_PARAMS, REFERENCE_PARAMS  # noqa: F401
from lapse.session import get_spark  # noqa: F401
