"""Tables with columns of any name, kept apart from those that an operator makes on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Given:
    """A table whose columns are renamed to in_0, in_1, ..., so that no name of theirs can clash with another."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.own = [f"in_{i}" for i in range(len(self.names))]
        self.types = [t for _, t in df.dtypes]
        self.df = df.toDF(*self.own)

    def name(self, column: str) -> str:
        return self.own[self.names.index(column)]

    def __getitem__(self, column: str) -> Column:
        return F.col(self.name(column))

    def type(self, column: str) -> str:
        return self.types[self.names.index(column)]

    def free(self, *added: str) -> list[str]:
        """Names for added columns: one that the table has already, in any case, gets underscores behind it."""
        taken, out = {n.lower() for n in self.names}, []
        for name in added:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out.append(name)
        return out

    def back(self, df: DataFrame, changed: dict[str, Column] | None = None, added: dict[str, Column] | None = None) -> DataFrame:
        """The table's columns out of df under their names, some of them changed, then added ones under free names."""
        changed, added = changed or {}, added or {}
        first = [changed[n].alias(o) if n in changed else F.col(o) for n, o in zip(self.names, self.own, strict=True)]
        last = [c.alias(f"out_{i}") for i, c in enumerate(added.values())]
        return df.select(*first, *last).toDF(*self.names, *self.free(*added))
