"""Column expressions on alignment links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_state(sure: Column, possible: Column) -> Column:
    """SURE, POSS or OFF; a sure link is also possible."""
    return (F.when(F.coalesce(sure, F.lit(False)), "SURE")
            .when(F.coalesce(possible, F.lit(False)), "POSS")
            .otherwise("OFF"))


def is_sure(state: Column) -> Column:
    return state == "SURE"


def is_possible(state: Column) -> Column:
    return state.isin("SURE", "POSS")


def link_text(e_pos: Column, f_pos: Column, sure: Column, strength: Column | None = None) -> Column:
    """``f-e``, then ``-strength`` when there is one, else ``-P`` unless sure."""
    base = F.concat_ws("-", f_pos.cast("string"), e_pos.cast("string"))
    suffix = F.when(F.coalesce(sure, F.lit(False)), "").otherwise("-P")
    if strength is not None:
        suffix = F.coalesce(F.concat(F.lit("-"), strength.cast("string")), suffix)
    return F.concat(base, suffix)
