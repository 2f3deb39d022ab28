"""Schema matching for unknown formats: profiles, physics, assignment, memory, classifier, repair."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.geo import bearing, haversine_km
from telemill.functions.text import name_tokens


def profile(values: DataFrame, keys=("oem", "path")) -> DataFrame:
    """Statistics of each field's values; ``values(oem, path, dev, ord, value)`` holds text.

    One wide aggregate; steps and monotony come from the previous value of the same device.
    """
    num = F.when(F.col("value").rlike("^[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("value")).try_cast("double")
    w = Window.partitionBy(*keys, "dev").orderBy("ord")
    v = values.withColumn("num", num).withColumn("step", F.col("num") - F.lag("num").over(w))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return v.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(F.col("value").isNull()).alias("null_share"),
        share(F.col("num").isNotNull()).alias("numeric_share"),
        share(F.col("num") == F.rint("num")).alias("whole_share"),
        share(F.col("num") < 0).alias("negative_share"),
        F.count_distinct("value").alias("distinct"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.avg("num").alias("mean"),
        F.stddev_pop("num").alias("sd"),
        F.percentile("num", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("quantiles"),
        F.avg(F.length("value")).alias("mean_length"),
        share(F.col("value").rlike("^[A-HJ-NPR-Z0-9]{17}$")).alias("vin_share"),
        share(F.col("value").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("iso_share"),
        share(F.upper("value").rlike("[PCBU][0-3][0-9A-F]{3}")).alias("dtc_share"),
        share(F.lower("value").isin("true", "false", "on", "off", "yes", "no")).alias("flag_share"),
        share(F.col("step") >= 0).alias("rising_share"),
        share(F.col("step") > 0).alias("strictly_rising_share"),
        F.percentile(F.abs("step"), 0.5).alias("step_median"),
    )


def movement(track: DataFrame, k: int = 8) -> DataFrame:
    """Points ``k`` steps apart in one device's track: distance, seconds, implied speed, bearing."""
    w = Window.partitionBy("dev").orderBy("ord")
    t = track.withColumn("lat2", F.lead("lat", k).over(w)).withColumn("lon2", F.lead("lon", k).over(w)).withColumn("t2", F.lead("t", k).over(w)).where("lat2 is not null")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return t.select("dev", "ord", km.alias("km"), (F.col("t2") - F.col("t")).alias("seconds"), F.try_divide(km * 3600, F.col("t2") - F.col("t")).alias("kmh"), bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("bearing"))


def ratio_fit(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median of y / x and its relative spread (MAD): a field in another unit has a constant ratio."""
    r = pairs.where((F.col(x) != 0) & F.col(y).isNotNull()).withColumn("r", F.col(y) / F.col(x))
    mid = r.groupBy(*keys).agg(F.percentile("r", 0.5).alias("ratio"), F.count("*").alias("n"))
    off = r.join(mid, keys).withColumn("d", F.abs(F.col("r") - F.col("ratio")))
    return off.groupBy(*keys, "ratio", "n").agg(F.try_divide(F.percentile("d", 0.5), F.abs(F.col("ratio"))).alias("spread"))


def choose_position(samples: pd.DataFrame) -> pd.DataFrame:
    """Best (lat, lon, scale) among numeric fields of one source by plausible movement.

    ``samples(oem, dev, ord, path, num)``. A pair must lie in range under a scale and move at a credible, non-zero pace.
    """
    wide = samples.pivot_table(index=["dev", "ord"], columns="path", values="num", aggfunc="last").sort_index()
    best = None
    for scale in (1.0, 1e-6, 1e-7):
        for a in wide.columns:
            lat = wide[a] * scale
            if not lat.abs().le(90).all() or lat.std() == 0:
                continue
            for b in wide.columns:
                lon = wide[b] * scale
                if a == b or not lon.abs().le(180).all() or lon.std() == 0:
                    continue
                d = np.hypot(lat.groupby("dev").diff(), lon.groupby("dev").diff() * np.cos(np.radians(lat))).dropna() * 111.195
                if not len(d):
                    continue
                score = float(((d > 0) & (d < 0.2)).mean())
                if best is None or score > best[0] + 1e-9:
                    best = (score, a, b, scale)
    row = best or (0.0, None, None, None)
    return pd.DataFrame([{"oem": samples["oem"].iloc[0], "lat_path": row[1], "lon_path": row[2], "scale": row[3], "score": row[0]}])


def positions(samples: DataFrame) -> DataFrame:
    """One task a source: its numeric fields are tens, its samples a bounded set."""
    return samples.groupBy("oem").applyInPandas(choose_position, "oem string, lat_path string, lon_path string, scale double, score double")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of a rectangular matrix by shortest augmenting paths; pairs (row, column)."""
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in assign(cost.T))
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0] = row
        at, dist, prev, used = 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            r = owner[at]
            free = ~used
            free[0] = False
            slack = np.full(m + 1, np.inf)
            slack[1:] = cost[r - 1] - u[r] - v[1:]
            better = free & (slack < dist)
            dist[better], prev[better] = slack[better], at
            nxt = int(np.argmin(np.where(free, dist, np.inf)))
            step = dist[nxt]
            u[owner[used]] += step
            v[used] -= step
            dist[free] -= step
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[prev[at]]
            at = prev[at]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def assign_scores(score: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
    """Highest total score; pairs under ``least`` are dropped."""
    return [(r, c) for r, c in assign(-score) if score[r, c] >= least]


def joint_assignment(probabilities: DataFrame, least: float = 0.12) -> DataFrame:
    """``probabilities(oem, path, field, unit, p)``: per source one path a canonical field.

    Probabilities of a field's units add up; the unit is the likeliest one. One task a source, fields times paths.
    """
    g = probabilities.groupBy("oem", "path", "field").agg(F.sum("p").alias("p"), F.max_by("unit", "p").alias("unit"))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        m = f.pivot_table(index="path", columns="field", values="p", fill_value=0.0)
        pairs = assign_scores(m.to_numpy(), least)
        unit = f.set_index(["path", "field"])["unit"]
        rows = [(f["oem"].iloc[0], m.index[r], m.columns[c], unit.get((m.index[r], m.columns[c])), float(m.iat[r, c])) for r, c in pairs]
        return pd.DataFrame(rows, columns=["oem", "path", "field", "unit", "p"])

    return g.groupBy("oem").applyInPandas(solve, "oem string, path string, field string, unit string, p double")


def alternatives(probabilities: DataFrame, most: int = 8, least: float = 0.005) -> DataFrame:
    w = Window.partitionBy("oem", "path").orderBy(F.desc("p"), "field", "unit")
    return probabilities.where(F.col("p") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def name_vector(path: str, width: int = 256) -> list[float]:
    """Hashed character n-grams (2 to 4) of a field name's tokens, of length 1."""
    import re
    import zlib

    plain = re.sub(r"\[-?\d+\]", " ", path)
    words = re.sub(r"[^A-Za-z0-9]+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", plain)).lower().split()
    out = np.zeros(width)
    for w in words:
        padded = f" {w} "
        for n in (2, 3, 4):
            for k in range(len(padded) - n + 1):
                out[zlib.crc32(padded[k : k + n].encode()) % width] += 1
    size = np.linalg.norm(out)
    return (out / size if size else out).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def name_vectors(path: pd.Series) -> pd.Series:
    return path.map(name_vector)


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def embedding(dense, name):
    """Dense part times 0.4 and name part times 0.6, joined and scaled to length 1."""
    both = F.concat(F.transform(dense, lambda x: x * 0.4), F.transform(name, lambda x: x * 0.6))
    size = F.sqrt(F.aggregate(both, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(both, lambda x: x / size)).otherwise(both)


def event_table(codes: DataFrame, learned: dict[str, str] | None = None) -> DataFrame:
    """Majority event of each source code; learned overrides win."""
    w = Window.partitionBy("oem", "code").orderBy(F.desc("n"), "evt")
    best = codes.groupBy("oem", "code", "evt").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if not learned:
        return best
    table = F.create_map(*[F.lit(x) for kv in learned.items() for x in kv])
    return best.withColumn("evt", F.coalesce(F.try_element_at(table, F.col("code").cast("string")), F.col("evt")))


def without_fragments(samples: DataFrame, leaves: str = "leaves", share: float = 0.6) -> DataFrame:
    """Samples with at least ``share`` of the leaves of a whole message of their source."""
    whole = samples.groupBy("oem").agg(F.percentile(leaves, 0.9).alias("_whole"))
    return samples.join(whole, "oem").where(F.col(leaves) >= share * F.col("_whole")).drop("_whole")


def train_classifier(rows: DataFrame, features: list[str], label: str, trees: int = 60, seed: int = 3):
    """Random forest over profile features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep"), VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=trees, maxDepth=12, seed=seed)]).fit(rows)


def scores(predicted: DataFrame, label: str = "label", guess: str = "guess") -> DataFrame:
    """Accuracy, and precision and recall by label."""
    hit = F.col(label) == F.col(guess)
    by_label = predicted.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("hit"))
    by_guess = predicted.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("told"))
    j = by_label.join(by_guess, "label", "left").withColumn("told", F.coalesce("told", F.lit(0)))
    p, r = F.try_divide(F.col("hit"), F.col("told")), F.col("hit") / F.col("n")
    return j.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def repair(spec: dict, accuracy, candidates: dict[str, list[dict]], optional: set[str], rounds: int = 3, drop_under: float = 0.5) -> dict:
    """Coordinate descent over field mappings: ``accuracy(spec)`` gives the accuracy by field; at most ``rounds`` rounds."""
    best, now = dict(spec["fields"]), accuracy(spec)
    for _ in range(rounds):
        moved = False
        for name in sorted(best):
            if now.get(name, 0.0) >= 1.0:
                continue
            for c in candidates.get(name, []):
                trial = {**spec, "fields": {**best, name: c}}
                then = accuracy(trial)
                if then.get(name, 0.0) > now.get(name, 0.0):
                    best, now, moved = trial["fields"], then, True
        if not moved:
            break
    return {**spec, "fields": {k: v for k, v in best.items() if k not in optional or now.get(k, 0.0) >= drop_under}}


def tokens(fields: DataFrame) -> DataFrame:
    return fields.withColumn("tokens", name_tokens(F.col("path")))
