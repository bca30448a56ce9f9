"""Stage tables of the validation pipeline over one data folder.

Panel, scored panel, price grid, returns and the delisted catalog are written once per
application and read by everything downstream, as the batch pipeline stores them between steps.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pitscore import params
from pitscore.operators import asof, ingest, returns, scoring
from pitscore.plans.panel import factor_panel, historical_raw, panel_of
from pitscore.session import stage
from pitscore.sources import samples

WEIGHTS = params.named_candidates()["evidence_based"]


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def view(self, name: str) -> DataFrame:
        return samples.view(self.spark, self.sf_dir, name)

    def _stage(self, name: str, build) -> DataFrame:
        return stage(self.spark, (self.sf_dir, name), build)

    @cached_property
    def calendar(self) -> list[date]:
        return asof.panel_quarters(asof.quarter_ends(self.spark, samples.START, samples.END))

    @cached_property
    def quarters(self) -> list[date]:
        """Quarters that occur in the panel."""
        return asof.panel_quarters(self.panel)

    @property
    def prices(self) -> DataFrame:
        return self._stage("prices", lambda: self.view("prices"))

    @property
    def fundamentals(self) -> DataFrame:
        return self._stage("fundamentals", lambda: self.view("fundamentals"))

    @property
    def members(self) -> DataFrame:
        return self._stage("members", lambda: ingest.membership_panel(self.view("membership_history"), self.calendar))

    @property
    def raw(self) -> DataFrame:
        return self._stage("raw", lambda: historical_raw(self.members, self.prices, self.fundamentals))

    def build_panel(self) -> DataFrame:
        """Panel with the universe's sectors, from the input tables."""
        return ingest.first_sector(factor_panel(self.members, self.prices, self.fundamentals), self.view("universe"))

    @property
    def panel(self) -> DataFrame:
        return self._stage("panel", lambda: ingest.first_sector(panel_of(self.raw), self.view("universe")))

    @property
    def scored(self) -> DataFrame:
        return self._stage("scored", lambda: scoring.score_panel(self.panel, WEIGHTS))

    @property
    def grid(self) -> DataFrame:
        return self._stage("grid", lambda: asof.prices_at_quarters(self.prices, self.quarters))

    @property
    def forward(self) -> DataFrame:
        return self._stage("forward", lambda: returns.forward_returns(self.panel, self.prices, self.quarters))

    @property
    def monthly(self) -> DataFrame:
        return self._stage("monthly", lambda: returns.monthly_returns(self.prices))

    @property
    def delisted(self) -> DataFrame:
        return self._stage("delisted", lambda: ingest.delisted_catalog(self.members, self.prices))
