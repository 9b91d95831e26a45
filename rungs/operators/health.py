"""How complete, fresh and translated the data is, and how the jobs run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X



def processing_health(entries: DataFrame) -> DataFrame:
    """bracket, total, fully, eq_only, spec_only, none, pct (fully), over all regions."""
    e, t = F.col("equipment_at").isNotNull(), F.col("talents_at").isNotNull()
    out = entries.groupBy("bracket").agg(F.count("*").alias("total"), F.count_if(e & t).alias("fully"), F.count_if(e & ~t).alias("eq_only"), F.count_if(~e & t).alias("spec_only"), F.count_if(~e & ~t).alias("none"))
    return out.withColumn("pct", X.pct(F.col("fully"), F.col("total"), 1, 100.0))


def availability(characters: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """available, cooldown, private among the characters that have entries: one row."""
    c = characters.join(entries.select("character_id").distinct(), "character_id", "left_semi")
    private, waits = F.coalesce("is_private", F.lit(False)), F.coalesce(F.col("unavailable_until") > as_of, F.lit(False))
    return c.agg(F.count_if(~private & ~waits).alias("available"), F.count_if(~private & waits).alias("cooldown"), F.count_if(private).alias("private"))


def freshness(entries: DataFrame, as_of: Column, column: str = "equipment_at", steps: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """Entries by age in hours: under each step from the one before on, and over the last; one row."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col(column))) / 3600
    edges = [None, *steps, None]
    cols = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        inside = (F.lit(True) if lo is None else age >= lo) & (F.lit(True) if hi is None else age < hi) & age.isNotNull()
        cols.append(F.count_if(inside).alias(f"under_{hi}h" if hi is not None else f"over_{lo}h"))
    return entries.agg(*cols)


def translation_coverage(ids: DataFrame, translations: DataFrame, locales: list[str], key: str = "name") -> DataFrame:
    """type, locale, total, present, missing, pct of the ids (type, id) that have a translation in each locale."""
    wanted = ids.select("type", "id").distinct().withColumn("locale", F.explode(F.array(*[F.lit(x) for x in locales])))
    have = translations.where(F.col("key") == key).select("type", "id", "locale").distinct().withColumn("_has", F.lit(1))
    out = wanted.join(have, ["type", "id", "locale"], "left").groupBy("type", "locale").agg(F.count("*").alias("total"), F.count("_has").alias("present"))
    return out.withColumns({"missing": F.col("total") - F.col("present"), "pct": X.pct(F.col("present"), F.col("total"), 1, 100.0)})


def missing_locales(ids: DataFrame, translations: DataFrame, locales: list[str], key: str = "name") -> DataFrame:
    """type, id, missing of the ids that lack some locale."""
    have = translations.where((F.col("key") == key) & F.col("locale").isin(locales)).groupBy("type", "id").agg(F.collect_set("locale").alias("_have"))
    rows = ids.select("type", "id").distinct().join(have, ["type", "id"], "left")
    rows = rows.withColumn("missing", F.array_sort(F.array_except(F.array(*[F.lit(x) for x in locales]), F.coalesce("_have", F.array().cast("array<string>")))))
    return rows.where(F.size("missing") > 0).select("type", "id", "missing")


def region_distribution(entries: DataFrame, regions: list[str], order: list[str] | None = None) -> DataFrame:
    """bracket, spec_id, a count for each region, total, pct of the bracket to one decimal, and the bracket's place in `order`."""
    c = entries.where(F.col("region").isin(regions) & F.col("spec_id").isNotNull()).groupBy("bracket", "spec_id").pivot("region", regions).agg(F.count(F.lit(1)))
    c = c.fillna(0, regions).withColumn("total", sum((F.col(f"`{r}`") for r in regions), F.lit(0)))
    c = c.withColumn("pct", X.pct(F.col("total"), F.sum("total").over(W.partitionBy("bracket")), 1))
    if order:
        c = c.withColumn("place", F.array_position(F.array(*[F.lit(b) for b in order]), F.col("bracket")))
    return c


def solo_distribution(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """class_slug, total, specs (spec_id, spec_slug, count by id) from per-spec solo brackets; only the spec that a bracket names."""
    named = entries.withColumns({"_class": X.bracket_class(F.col("bracket")), "_spec": X.bracket_spec(F.col("bracket"))})
    c = F.broadcast(catalog)  # forty rows
    own = named.join(c, (named["_class"] == c["class_slug"]) & (named["_spec"] == F.translate(c["spec_slug"], "-", "")) & (named["spec_id"] == c["spec_id"])).select(c["class_slug"], c["spec_id"], c["spec_slug"])
    per = own.groupBy("class_slug", "spec_id", "spec_slug").agg(F.count("*").alias("count"))
    return per.groupBy("class_slug").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("spec_id", "spec_slug", "count"))).alias("specs"))


def _window(metrics: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return metrics.where((F.col("at") > as_of - F.make_interval(hours=F.lit(hours))) & (F.col("at") <= as_of))


def _summary() -> list[Column]:
    ok = F.count_if(F.col("success"))
    return [F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("failed"), X.pct(ok, F.count("*")).alias("success_pct"), X.half_up(F.avg("duration"), 3).alias("avg_duration"), F.max("duration").alias("max_duration"), F.min("duration").alias("min_duration")]


def job_summary(metrics: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """total, ok, failed, success_pct and the durations' mean, maximum and minimum of jobs in the hours before as_of: one row."""
    return _window(metrics, as_of, hours).agg(*_summary())


def job_stats(metrics: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return _window(metrics, as_of, hours).groupBy("job_class").agg(*_summary())


def error_distribution(metrics: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return _window(metrics, as_of, hours).where(~F.col("success")).groupBy("error_class").agg(F.count("*").alias("failures"))


def slow_jobs(metrics: DataFrame, threshold: float) -> DataFrame:
    return metrics.where(F.col("duration") > threshold).orderBy(F.desc("duration"), "job_id")


def queue_health(metrics: DataFrame, as_of: Column, queues: dict[str, str], expected_rate: float, hours: int = 1) -> DataFrame:
    """queue, jobs, avg_duration, failure_rate, throughput (a second) and what to do about them.

    queues: pattern of job classes to queue, the first that fits; others are `default`.
    """
    queue = F.lit("default")
    for pattern, name in reversed(queues.items()):
        queue = F.when(F.col("job_class").rlike(pattern), name).otherwise(queue)
    q = _window(metrics, as_of, hours).withColumn("queue", queue).groupBy("queue")
    q = q.agg(F.count("*").alias("jobs"), X.half_up(F.avg("duration"), 3).alias("avg_duration"), X.pct(F.count_if(~F.col("success")), F.count("*")).alias("failure_rate"))
    q = q.withColumn("throughput", F.col("jobs") / F.lit(3600.0 * hours))
    todo = F.array(F.when(F.col("avg_duration") > 30, "slow"), F.when(F.col("failure_rate") > 10, "failing"), F.when(F.col("throughput") < expected_rate, "behind"))
    return q.withColumn("recommendations", F.filter(todo, lambda x: x.isNotNull()))


def batch_outcome(results: DataFrame, sample: int = 5) -> DataFrame:
    """batch_id, counts by status, failure share, whether all failed, and up to `sample` failures by id."""
    failed = F.col("status") == "failed"
    # of each batch, the first few failures by id only
    first = results.where(failed).withColumn("_k", F.row_number().over(W.partitionBy("batch_id").orderBy("id"))).where(F.col("_k") <= sample)
    first = first.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("id", "message"))).alias("failures"))
    out = results.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(failed).alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    out = out.withColumns({"failure_pct": X.pct(F.col("failed"), F.col("total")), "all_failed": (F.col("failed") == F.col("total")) & (F.col("total") > 0)})
    return out.join(first, "batch_id", "left")


def regression_check(counts: DataFrame, baseline: DataFrame, floor: int = 100, share: float = 0.5) -> DataFrame:
    """talent_type, n, last, reason of the types of the baseline (last success) below the floor or half of what they had."""
    rows = baseline.select("talent_type", F.col("n").alias("last")).join(counts.select("talent_type", "n"), "talent_type", "full").fillna(0, ["n"])
    reason = F.when(F.col("n") < floor, "below floor").when(F.col("n") < share * F.col("last"), "below last success")
    return rows.withColumn("reason", reason).where("reason is not null")


def sync_report(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("equipment_at").isNull() | F.col("talents_at").isNull()).alias("unsynced"))


def processed_counts(entries: DataFrame) -> DataFrame:
    """character_id, equipment and talents (entries processed), and whether each Last-Modified stamp is stale (none is)."""
    out = entries.groupBy("character_id").agg(F.count("equipment_at").alias("equipment"), F.count("talents_at").alias("talents"))
    return out.withColumns({"equipment_stale": F.col("equipment") == 0, "talents_stale": F.col("talents") == 0})


def sync_diagnosis(characters: DataFrame, items: DataFrame, talents: DataFrame, entries: DataFrame) -> DataFrame:
    """character_id, item and talent rows, the latest entry's gates, and a verdict."""
    latest = entries.groupBy("character_id").agg(F.max_by(F.struct("equipment_at", "talents_at"), F.struct("snapshot_at", "entry_id")).alias("_e"))
    n = lambda d, name: d.groupBy("character_id").agg(F.count("*").alias(name))
    rows = characters.select("character_id").join(n(items, "items"), "character_id", "left").join(n(talents, "talents"), "character_id", "left").join(latest, "character_id", "left").fillna(0, ["items", "talents"])
    eq, ta = F.col("_e.equipment_at").isNotNull(), F.col("_e.talents_at").isNotNull()
    verdict = F.when(F.col("_e").isNull(), "no entry").when(eq & ta & (F.col("items") > 0) & (F.col("talents") > 0), "ok").when(~eq & ~ta, "never processed").when(eq & (F.col("items") == 0), "items missing").when(ta & (F.col("talents") == 0), "talents missing").otherwise("partly processed")
    return rows.select("character_id", "items", "talents", F.col("_e.equipment_at").alias("equipment_at"), F.col("_e.talents_at").alias("talents_at"), verdict.alias("verdict"))
