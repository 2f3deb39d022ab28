"""Routing: which live versions of a source may read a payload, and what comes of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.text import device_bucket
from telemill.functions.values import SpecError
from telemill.plans.compile import Spec, compile_spec

#: errors that only say "another format": the next version may try
FALLBACK = ("SCHEMA_MISMATCH", "DECODE_ERROR")


@dataclass
class Routes:
    active: list[Spec] = field(default_factory=list)  # newest first
    canary: Spec | None = None
    canary_pct: int = 0

    def read(self, rows: DataFrame, payload: str = "value", device: str = "key") -> DataFrame:
        """``rows`` with ``event, error, version, attempt`` of the first version that reads the payload.

        A canary goes first for its share of devices and last for the others. The first attempt's error is
        reported; an error that is not about the format ends the attempts.
        """
        own = list(rows.columns)
        specs = [*([self.canary] if self.canary else []), *self.active]
        for s in specs:
            rows = s.read(rows, payload, f"_v{s.version}_")
        late = [*self.active, *([self.canary] if self.canary else [])]
        if len(specs) == 1 or self.canary is None or not self.active:
            got = self._chain(late)
        else:
            got = F.when(device_bucket(F.col(device)) < self.canary_pct, self._chain(specs)).otherwise(self._chain(late))
        rows = rows.withColumn("_won", got)
        event = F.coalesce(*[F.when(F.col("_won.version") == s.version, F.col(f"_v{s.version}_event")) for s in specs])
        error = F.coalesce(*[F.when(F.col("_won.first") == s.version, F.col(f"_v{s.version}_error")) for s in specs])
        fine = F.col("_won.version").isNotNull()
        # one-row generator: a filter on the outcome stays above it, instead of being rewritten through every stage below
        row = F.struct(event.alias("event"), F.when(~fine, error).alias("error"), F.coalesce("_won.version", "_won.first").alias("version"), F.col("_won.attempt").alias("attempt"))
        return rows.select(*own, F.inline(F.array(row)))

    @staticmethod
    def _chain(specs: list[Spec]) -> Column:
        """``struct(version, first, attempt)``: the version that read it, or null; the first one tried."""
        out = None
        for n in range(len(specs) - 1, -1, -1):
            error = F.col(f"_v{specs[n].version}_error")
            pack = lambda v, n=n: F.struct(v.alias("version"), F.lit(specs[0].version).alias("first"), F.lit(n).alias("attempt"))
            failed, fine = pack(F.lit(None).cast("int")), pack(F.lit(specs[n].version))
            out = F.when(error.isNull(), fine).otherwise(failed) if out is None else F.when(error.isNull(), fine).when(~error["reason"].isin(*FALLBACK), failed).otherwise(out)
        return out


def routing_table(versions: list[dict]) -> tuple[dict[str, Routes], list[str]]:
    """Snapshot from registry rows ``{oem, version, state, canary_pct, spec}``: live ones only, newest first, the first
    canary wins; a spec that does not compile is skipped and reported."""
    table: dict[str, Routes] = {}
    errors: list[str] = []
    for row in sorted(versions, key=lambda r: (r["oem"], -r["version"])):
        if row["state"] not in ("active", "canary"):
            continue
        try:
            spec = compile_spec(row["oem"], row["version"], row["spec"])
        except SpecError as e:
            errors.append(f"{row['oem']} v{row['version']}: {e}")
            continue
        own = table.setdefault(row["oem"], Routes())
        if row["state"] == "active":
            own.active.append(spec)
        elif own.canary is None:
            own.canary, own.canary_pct = spec, int(row.get("canary_pct") or 0)
    return table, errors
