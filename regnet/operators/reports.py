"""Counts that a job makes on its way: rows, rows by chromosome, distinct names. They are observed in the pass that needs the
rows anyway; there is no job for them alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Chromosomes that are counted one by one; more are counted together.
MOST = 1000


class Reports:
    """Observations by name. Their values are there once a job has gone over the rows."""

    def __init__(self, chromosomes: list[str]) -> None:
        self.chromosomes, self.seen = chromosomes[:MOST], {}

    @staticmethod
    def of(genes: DataFrame) -> Reports:
        """Counts by the chromosomes that genes lie on."""
        found = genes.select("seqname").filter("seqname IS NOT NULL").distinct().orderBy("seqname").limit(MOST).collect()
        return Reports([r[0] for r in found])

    def watch(self, df: DataFrame, what: str, *, chromosome: str | None = None, names: str | None = None) -> DataFrame:
        """df, whose rows are counted as they pass; chromosome: column to count by; names: column whose distinct values are counted."""
        cells = [F.count(F.lit(1)).alias("rows")]
        if chromosome is not None:
            c = F.col(chromosome)
            cells += [F.count_if(c == x).alias(f"chromosome {x}") for x in self.chromosomes]
            cells.append(F.count_if(F.coalesce(~c.isin(self.chromosomes), F.lit(True))).alias("other chromosomes"))
        if names is not None:
            cells.append(F.size(F.collect_set(names)).alias("distinct names"))
        self.seen[what] = Observation(f"{what} {id(self)}")
        return df.observe(self.seen[what], *cells)

    def lines(self) -> list[tuple[str, str, int]]:
        """(what was counted, by what, how many), in order."""
        return [(what, name, int(n)) for what, o in self.seen.items() for name, n in o.get.items()]
