from lapse.sources.io import (  # noqa: F401
    table, read_csv, csv_to_parquet, write_once, table_stats, write_splits,
    load_splits, write_scores, write_json, DRIVER_TABLES,
)
from lapse.sources.schemas import MEMBERS, TRANSACTIONS, USER_LOGS, LABELS  # noqa: F401
