from vintage.functions.numeric import (
    rnd, month_diff, month_start, ltv_quotient, nan_to_null, stable_avg, exact_sum, fixed, general,
)

__all__ = ["rnd", "month_diff", "month_start", "ltv_quotient", "nan_to_null", "stable_avg", "exact_sum", "fixed", "general"]
