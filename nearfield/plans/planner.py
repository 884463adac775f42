"""Choice of a filtered-search strategy from the filter's selectivity.

- brute_force: few rows match; they are scanned exactly.
- bitmap: some match; the filter is applied to the candidates before the budget is spent.
- post_filter: most match; more neighbours than asked for are fetched and filtered afterwards.  If too few
  survive and the strategy was the planner's own choice, the search is done again as bitmap.

The strategies are recipes for DataFrames; Catalyst plans each.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument
from nearfield.functions.filters import Filter, canonical, check, compile_filter, estimate, flag, literals, parse
from nearfield.functions.stats import resolve
from nearfield.operators.topk import top_k

STRATEGIES = ("brute_force", "bitmap", "post_filter")


@dataclass
class Plan:
    strategy: str
    selectivity: float
    exact: bool


@dataclass
class Planner:
    brute_force_max_selectivity: float = 0.02
    post_filter_min_selectivity: float = 0.1
    post_filter_max_ef: int = 1024
    exact_selectivity_below: int = 50_000
    mask_cache_size: int = 64
    masks: OrderedDict = field(default_factory=OrderedDict)

    def selectivity(self, node: Filter, records: DataFrame, kinds: dict[str, str], stats: dict[str, dict] | None, n: int) -> tuple[float, bool]:
        """The share of live rows that match, and whether it was counted; estimated only for large collections."""
        check(node, kinds)
        if stats and n >= self.exact_selectivity_below:
            guess = estimate(node, resolve(stats, literals(node), records.sparkSession))
            if guess is not None:
                return guess, False
        share = records.agg(F.avg(flag(node, kinds).cast("double"))).first()[0]
        return (share or 0.0), True

    def plan(self, node: Filter, records: DataFrame, kinds: dict[str, str], stats: dict[str, dict] | None = None, n: int = 0, force: str | None = None, exact_index: bool = False) -> Plan:
        if force is not None and force not in STRATEGIES:
            raise InvalidArgument(f"unknown strategy {force!r}")
        share, exact = self.selectivity(node, records, kinds, stats, n)
        if force:
            return Plan(force, share, exact)
        if exact_index or share <= self.brute_force_max_selectivity:
            return Plan("brute_force", share, exact)
        return Plan("bitmap" if share < self.post_filter_min_selectivity else "post_filter", share, exact)

    def fetch(self, k: int, share: float) -> int:
        """How many neighbours post_filter asks for."""
        return min(self.post_filter_max_ef, math.ceil(1.5 * k / max(share, 1e-3)) + 4)

    def mask(self, node: Filter, records: DataFrame, kinds: dict[str, str], version: int) -> DataFrame:
        """The matching rows, persisted under (filter, version); the least recently used go when there are too many."""
        for key in [k for k in self.masks if k[1] != version]:
            self.masks.pop(key).unpersist()
        key = (canonical(node), version)
        if key not in self.masks:
            self.masks[key] = records.where(compile_filter(node, kinds)).persist()
        self.masks.move_to_end(key)
        while len(self.masks) > self.mask_cache_size:
            self.masks.popitem(last=False)[1].unpersist()
        return self.masks[key]

    def clear(self) -> None:
        while self.masks:
            self.masks.popitem()[1].unpersist()


@dataclass
class Found:
    """A search's rows (all columns and `distance`), and how they were found."""

    rows: DataFrame
    strategy: str
    ef: int
    selectivity: float | None
    stats: dict = field(default_factory=dict)


def filtered_search(
    records: DataFrame,
    kinds: dict[str, str],
    query: list[float],
    k: int,
    text: str,
    planner: Planner,
    stats: dict[str, dict] | None = None,
    n: int = 0,
    strategy: str | None = None,
    ef: int = 64,
    near: Callable[[DataFrame, int, int], DataFrame] | None = None,
    version: int = 0,
    id: str = "id",
    learned: Callable[[float], int] | None = None,
) -> Found:
    """The k nearest records that satisfy a filter.

    `near(records, k, ef)` is the index's search; without one every strategy searches exactly, and they differ
    in where the filter stands.  `learned(selectivity)`, if given, is the budget of a bitmap search.
    """
    node = parse(text)
    predicate = compile_filter(node, kinds)
    plan = planner.plan(node, records, kinds, stats, n, strategy, exact_index=near is None and strategy is None)
    search = near or (lambda rows, k, ef: top_k(rows, query, k, id))
    counters = lambda: getattr(near, "stats", {})
    # An index counts all rows of a cell, a bitmap search those that match.
    reach = lambda budget: math.ceil(budget / max(plan.selectivity, 1e-3))
    if plan.strategy == "brute_force":
        return Found(top_k(records.where(predicate), query, k, id), plan.strategy, 0, plan.selectivity)
    if plan.strategy == "bitmap":
        rows = planner.mask(node, records, kinds, version) if near is None else records.where(predicate)
        if near is not None and learned is not None:
            found = search(rows, k, reach(learned(plan.selectivity)))
            return Found(found, "bitmap+early_stop", counters().get("probes", 0), plan.selectivity, counters())
        return Found(search(rows, k, reach(ef)), plan.strategy, ef, plan.selectivity, counters())
    fetch = planner.fetch(k, plan.selectivity)
    ef_post = min(max(ef, fetch), planner.post_filter_max_ef)
    # The filter stands above the limit, so Catalyst leaves it there.
    rows = search(records, fetch, ef_post).where(predicate).orderBy("distance", id).limit(k)
    if strategy is None:
        # At most post_filter_max_ef rows: collected, so that the search is not run again when they are read.
        got = rows.collect()
        if len(got) < k:
            return Found(search(records.where(predicate), k, reach(ef)), "post_filter+bitmap", ef, plan.selectivity, counters())
        rows = records.sparkSession.createDataFrame(got, rows.schema)
    return Found(rows, plan.strategy, ef_post, plan.selectivity, counters())


def compare(records: DataFrame, kinds: dict[str, str], query: list[float], k: int, text: str, planner: Planner, id: str = "id") -> list[dict]:
    """Each strategy's recall against the exact answer."""
    truth = {r[0] for r in top_k(records.where(compile_filter(parse(text), kinds)), query, k, id).select(id).collect()}
    found = []
    for strategy in (None, *STRATEGIES):
        got = filtered_search(records, kinds, query, k, text, planner, strategy=strategy, id=id)
        ids = {r[0] for r in got.rows.select(id).collect()}
        found.append({"strategy": got.strategy, "forced": strategy is not None, "selectivity": got.selectivity, "recall": len(ids & truth) / len(truth) if truth else 1.0})
    return found


