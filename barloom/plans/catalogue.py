"""Imports every plan module so that its queries are registered."""

from barloom.plans import factor_plans, ic_plans, indicator_plans, join_plans, model_plans, pick_plans, signal_plans, storage_plans, stream_plans, table_plans, trade_plans  # noqa: F401
from barloom.plans.registry import builders, sql_texts  # noqa: F401
