from lapse.functions.dates import ymd, try_ymd, to_ymd_int  # noqa: F401
from lapse.functions.exprs import (  # noqa: F401
    clean_age, age_bucket, clip_secs, song_completion, ratio_plus_one, trend,
    cox_target, has_positive, registration_year, segment_label, discount_ratio,
    txn_frequency, missing_label, safe_div,
)
