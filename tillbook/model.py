"""The retail tables every report works on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tillbook.operators import summaries

Table = DataFrame | Callable[[], DataFrame]


def _as_built(name: str, build: Callable[[], DataFrame], facts: Callable[[], list]) -> DataFrame:
    return build()


class RetailModel:
    """Transactions, items and the summaries derived from them.

    ``transactions``  transaction_id, ts, store, time_of_day
    ``items``         transaction_id, item_name, item_flavour, item_size, price
                      Either may be a function that opens the table; it is only
                      called by a report that reads the table itself.
    ``store_groups``  group name -> stores, in the order the group lists them
    ``keep``          decides where a summary lives: it gets the name, a function
                      that builds it and one that returns the tables it is built
                      from. By default a summary is a lazy part of the plan of
                      each report, which then joins the facts itself.
    ``given``         summaries that exist already as tables
    """

    def __init__(
        self,
        transactions: Table,
        items: Table,
        store_groups: Mapping[str, Sequence[str]] | None = None,
        keep: Callable[[str, Callable[[], DataFrame], Callable[[], list]], DataFrame] = _as_built,
        given: Mapping[str, DataFrame] | None = None,
    ) -> None:
        self._facts = {"transactions": transactions, "items": items}
        self.store_groups = dict(store_groups or {})
        self._keep = keep
        self.given = dict(given or {})
        self._tables = dict(self.given)

    @property
    def transactions(self) -> DataFrame:
        return self._fact("transactions")

    @property
    def items(self) -> DataFrame:
        return self._fact("items")

    @property
    def sold(self) -> DataFrame:
        return self._summary("sold", lambda: summaries.sold(self.transactions, self.items))

    @property
    def daily_store(self) -> DataFrame:
        return self._summary("daily_store", self._daily_store)

    @property
    def store_days(self) -> DataFrame:
        return self._summary(
            "store_days", lambda: summaries.store_days(self.transactions)
        )

    @property
    def store_months(self) -> DataFrame:
        return self._summary("store_months", lambda: summaries.store_months(self.store_days))

    @property
    def store_balances(self) -> DataFrame:
        return self._summary("store_balances", lambda: summaries.store_balances(self.daily_store))

    @property
    def item_hours(self) -> DataFrame:
        return self._summary("item_hours", lambda: summaries.item_hours(self._joined()))

    @property
    def item_kinds(self) -> DataFrame:
        return self._summary("item_kinds", lambda: summaries.item_kinds(self.item_hours))

    def _fact(self, name: str) -> DataFrame:
        table = self._facts[name]
        if not isinstance(table, DataFrame):
            table = self._facts[name] = table()
        return table

    def _daily_store(self) -> DataFrame:
        joined = self._tables.get("sold")
        if joined is None:
            return summaries.daily_store(self.transactions, self.items)
        return summaries.daily_store_of(joined)

    def _joined(self) -> DataFrame:
        """The joined facts: their table if there is one, else the join as a part of the plan."""
        joined = self._tables.get("sold")
        return summaries.sold(self.transactions, self.items) if joined is None else joined

    def _summary(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._keep(name, build, self._sources)
        return self._tables[name]

    def _sources(self) -> list[DataFrame]:
        """All tables that a summary may be built from."""
        return [self.transactions, self.items, *(self.given[name] for name in sorted(self.given))]
