"""Models of several providers: which to ask, and in what order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the names of models too weak to ask.
WEAK = ("lite", "-8b", "8b-", "-4b", "-3b", "-1b", "-mini", "-small", "nano")


def pool(models: DataFrame, most: int = 5) -> DataFrame:
    """provider, model, r: the `most` models of each provider by context (null as 0), those of weak names left out; ties go to the later name."""
    weak = F.lit(False)
    for w in WEAK:
        weak = weak | F.lower("model").contains(w)
    r = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc(F.coalesce("context", F.lit(0))), F.desc("model")))
    return models.where(~weak).withColumn("r", r).where(F.col("r") <= most).select("provider", "model", "r")


class Ring:
    """Providers in turn, each with its models. A call begins one provider further than the last; a model that answers moves to the front
    of its pool, one that fails to the end; a provider whose models all fail hands over to the next and stays in the ring."""

    def __init__(self, pools: dict[str, list[str]]) -> None:
        self.pools = {k: list(v) for k, v in pools.items()}
        self.order, self.turn = list(self.pools), 0

    def ask(self, call: Callable[[str, str], str | None]) -> tuple[str, str, str] | None:
        """(provider, model, reply) of the first model that answers; None if none does."""
        start, self.turn = self.turn, self.turn + 1
        for k in range(len(self.order)):
            provider = self.order[(start + k) % len(self.order)]
            for model in list(self.pools[provider]):
                try:
                    reply = call(provider, model)
                except Exception:  # noqa: BLE001 -- any failure of a provider
                    reply = None
                own = self.pools[provider]
                own.remove(model)
                if reply:
                    own.insert(0, model)
                    return provider, model, reply
                own.append(model)
        return None
