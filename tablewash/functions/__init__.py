"""Cell semantics as Column expressions."""

from tablewash.functions.booleans import boolean_like, coerce_boolean
from tablewash.functions.dates import coerce_date, date_shape
from tablewash.functions.numbers import (
    coerce_number,
    exact_mean,
    exact_sum,
    formatted_number,
    number_of,
    round_display,
)
from tablewash.functions.text import is_blank, norm_key, num_text, strip, text_of

__all__ = [
    "boolean_like",
    "coerce_boolean",
    "coerce_date",
    "coerce_number",
    "date_shape",
    "exact_mean",
    "exact_sum",
    "formatted_number",
    "is_blank",
    "norm_key",
    "num_text",
    "number_of",
    "round_display",
    "strip",
    "text_of",
]
