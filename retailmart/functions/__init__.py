from .columns import (
    city_state,
    date_from_parts,
    full_name,
    in_period,
    parse_form_date,
    population_band,
    repair_discount,
    year_month_label,
)
from .money import amount, money, money_sum

__all__ = [
    "city_state",
    "date_from_parts",
    "full_name",
    "in_period",
    "amount",
    "money",
    "money_sum",
    "parse_form_date",
    "population_band",
    "repair_discount",
    "year_month_label",
]
