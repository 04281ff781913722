"""Registered queries: forecasts (rows-only: solver output is not SQL)."""

from __future__ import annotations

from attrix.forecast import models as FM
from attrix.plans.common import finalize, table

EV = ("events", "ts", "value", ["event_type"])


def _ev(s, sf):
    return table(s, sf, "events")


QUERIES = {
    "fc_holt_winters": lambda s, sf: finalize(FM.holt_winters(_ev(s, sf), "ts", "value", 30,
                                                              ["event_type"])),
    "fc_holt_winters_orders": lambda s, sf: finalize(FM.holt_winters(
        table(s, sf, "orders"), "o_orderdate", "o_totalprice", 30)),
    "fc_arima": lambda s, sf: finalize(FM.arima(_ev(s, sf), "ts", "value", 30, ["event_type"])),
    "fc_arima_orders": lambda s, sf: finalize(FM.arima(table(s, sf, "orders"), "o_orderdate",
                                                       "o_totalprice", 30)),
    "fc_additive": lambda s, sf: finalize(FM.additive(_ev(s, sf), "ts", "value", 30,
                                                      ["event_type"])),
    "fc_mape": lambda s, sf: finalize(FM.additive_report(
        FM.additive(_ev(s, sf), "ts", "value", 30, ["event_type"]), ["event_type"])),
    "fc_rf": lambda s, sf: finalize(FM.ml_forecast(_ev(s, sf), "ts", "value", 30, "rf",
                                                   ["event_type"])[0]),
    "fc_gbt": lambda s, sf: finalize(FM.ml_forecast(_ev(s, sf), "ts", "value", 30, "gbt",
                                                    ["event_type"])[0]),
    "fc_ml_report": lambda s, sf: finalize(FM.ml_forecast(_ev(s, sf), "ts", "value", 30, "rf",
                                                          ["event_type"])[1]),
}
ORACLE: dict = {}
