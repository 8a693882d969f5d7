"""Salary-capped lineups: Spark prunes and ranks candidates, a bounded greedy search runs once per slate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from downfield.functions.scalars import finite, value_per
from downfield.operators.relational import not_listed

# Slots of a lineup in filling order, who may fill the flexible one, the cap, and who is out.
SLOTS = {"QB": 1, "RB/FLEX": 2, "WR/FLEX": 3, "TE/FLEX": 1, "DEF": 1, "FLEX": 1}
FLEX = ("RB/FLEX", "WR/FLEX", "TE/FLEX")
FOCUS = ("QB", "RB/FLEX", "WR/FLEX", "TE/FLEX")
PER_FOCUS, ATTEMPTS, SALARY_CAP, MAX_USAGE = 5, 10, 60000, 50.0
OUT = ("IR", "O", "D")
RESULT = "slate string, lineup_id int, slot int, position string, nickname string, salary double, lineup_points double, injury string"


def candidates(slate: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """Healthy players with salary and points, by value; slate columns are slate, nickname, position, salary, fppg, injury, predicted."""
    out = not_listed(slate, "injury", OUT)
    out = out.withColumns({c: finite(F.col(c).cast("double")) for c in ("salary", "fppg", "predicted")}).dropna(subset=["salary", "fppg", "position", "nickname"])
    out = out.withColumn("lineup_points", F.when(F.col("position") == "DEF", F.col("fppg")).otherwise(F.col("predicted")))
    names = list(exclude)
    out = out.filter(~F.col("nickname").isin(names)) if names else out
    out = out.withColumn("value", value_per("lineup_points", "salary"))
    by_value = Window.partitionBy("slate", "position").orderBy(F.desc_nulls_last("value"), "nickname")
    by_points = Window.partitionBy("slate", "position").orderBy(F.desc_nulls_last("lineup_points"), "nickname")
    return out.withColumns({"value_rank": F.row_number().over(by_value), "points_rank": F.row_number().over(by_points)})


class Search:
    """The state of one slate's search: lineups so far and how often each player is in them."""

    def __init__(self, players: pd.DataFrame, wanted: int, cap: float, compat: bool, include: tuple[str, ...]):
        rows = players.sort_values(["value", "nickname"], ascending=[False, True], na_position="last")
        self.by_value = list(rows.itertuples(index=False))
        self.by_points = list(players.sort_values(["lineup_points", "nickname"], ascending=[False, True], na_position="last").itertuples(index=False))
        self.wanted, self.cap, self.compat, self.include = wanted, cap, compat, include
        self.used: Counter = Counter()
        self.lineups: list[list] = []
        self.known: set[frozenset] = set()

    def allowed(self, name: str) -> bool:
        return not self.lineups or (self.used[name] + 1) / self.wanted * 100 <= MAX_USAGE

    def around(self, focus) -> list | None:
        """A full lineup with the focus player, each slot by best value that fits; none if a slot stays open."""
        left, need, money = [focus], dict(SLOTS), self.cap - focus.salary
        need[focus.position] -= 1
        taken = set() if self.compat else {focus.nickname}
        for name in self.include:
            forced = next((p for p in self.by_value if p.nickname == name and name not in taken and p.nickname != focus.nickname), None)
            if forced is not None:
                slot = forced.position if need.get(forced.position) else "FLEX"
                if not need.get(slot) or forced.salary > money:
                    return None
                left.append(forced)
                taken.add(name)
                need[slot] -= 1
                money -= forced.salary
        for slot in SLOTS:
            if self.compat and slot == focus.position:
                continue
            kinds = FLEX if slot == "FLEX" else (slot,)
            for p in self.by_value:
                if not need[slot]:
                    break
                if p.position in kinds and p.nickname not in taken and p.salary <= money and self.allowed(p.nickname):
                    left.append(p)
                    taken.add(p.nickname)
                    need[slot] -= 1
                    money -= p.salary
            if need[slot]:
                return None
        return None if any(need.values()) else left

    def run(self) -> list[list]:
        for _ in range(self.wanted * ATTEMPTS):
            before = len(self.lineups)
            focus = FOCUS[min(before // PER_FOCUS, len(FOCUS) - 1)]
            for player in [p for p in self.by_points if p.position == focus][:PER_FOCUS]:
                if len(self.lineups) >= self.wanted:
                    return self.lineups
                made = self.around(player) if self.allowed(player.nickname) else None
                names = frozenset(p.nickname for p in made) if made else None
                if made and names not in self.known:
                    self.lineups.append(made)
                    self.known.add(names)
                    self.used.update(p.nickname for p in made)
            if len(self.lineups) == before:  # the next pass would be the same
                break
        return self.lineups


def optimize(slate: DataFrame, lineups: int, salary_cap: float = SALARY_CAP, exclude: Iterable[str] = (), include: Iterable[str] = (), compat: bool = False) -> DataFrame:
    """Lineups of each slate. ``compat`` leaves a focus position's other slots open, so that only QB and TE lineups complete."""
    forced = tuple(include)

    def search(players: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, made in enumerate(Search(players, lineups, salary_cap, compat, forced).run(), 1):
            rows += [(p.slate, i, k, p.position, p.nickname, p.salary, p.lineup_points, p.injury) for k, p in enumerate(made, 1)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    pool = candidates(slate, exclude).select("slate", "nickname", "position", "salary", "lineup_points", "injury", "value")
    return pool.groupBy("slate").applyInPandas(search, RESULT)  # a slate is a contest's list of players, all of whom a search may take
