"""Column-expression helpers (all built-in Spark SQL functions, no UDFs)."""

from .money import MONEY, MONEY_OUT, money, money_out, zero_money  # noqa: F401
from .periods import (  # noqa: F401
    ReportArgumentError,
    check_date_range,
    report_window,
    resolve_report_dates,
)
from .predicates import (  # noqa: F401
    date_between,
    day_range,
    not_cancelled,
    optional_filters,
    truthy_text,
)
from .text import (  # noqa: F401
    id_ok,
    new_id,
    normalize_mobile,
    required_text,
    stable_id,
)
