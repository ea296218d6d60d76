"""An anomaly job from events to results: features, models, records, the hierarchy above them, normalised scores, documents.

Every detector's bucket values meet a model: of each person's own series, with its state kept between runs, or of all members
of an attribute for detectors over a population.  A record's probability is on the detector's tail.  Probabilities of
one person in a bucket are combined over detectors, those of a partition over its persons, and those of a bucket over its
partitions.  Scores of each level are brought to 0-100 by the four ceilings, and what is unusual enough is written.

Rules that skip results take their records out, rules that skip model updates their values before learning.  Rarity, location and
mixed metric functions have no series of numbers and are refused here.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import expressions as X
from driftwell.operators import features, hierarchy, models, series
from driftwell.plans.config import Detector, JobConfig
from driftwell.sources import writers
from driftwell.sources.tables import dropped, written

REFUSED = ("rare", "rare_count", "freq_rare", "freq_rare_count", "lat_long", "metric")
COMPARE = {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
KEYS = ["detector", "bucket", "partition", "person", "attribute"]


@dataclass
class Results:
    records: DataFrame  # KEYS, actual, typical, probability, score, normalised, severity
    nodes: DataFrame  # level, bucket, partition, person, n, probability, score, normalised
    states: DataFrame  # detector, partition, person, state: what a later run goes on from

    def written_records(self, cutoff: float = hierarchy.CUTOFF) -> DataFrame:
        return self.records.where(F.col("probability") < cutoff)

    def written_nodes(self, cutoff: float = hierarchy.CUTOFF) -> DataFrame:
        return self.nodes.where(F.col("probability") < cutoff)

    def documents(self, span: int) -> DataFrame:
        """(document): each bucket with its largest score, then each record that is reported, as JSON."""
        buckets = writers.bucket_results(self.written_records(), "bucket", span, "normalised")
        return writers.as_documents(buckets, "bucket").unionByName(writers.as_documents(self.written_records(), "record"))


def on_tail(p: Column, actual: Column, typical: Column, tail: str) -> Column:
    """A two-sided probability as that of the tail: half of it on the tail's side, the rest of the other half elsewhere."""
    if tail == "two_sided":
        return p
    out_there = actual > typical if tail == "high" else actual < typical
    return F.when(out_there, F.greatest(p / 2, F.lit(models.LEAST))).otherwise(1 - p / 2)


def meets(d: Detector, action: str, actual: Column, typical: Column, bucket: Column) -> Column:
    """Whether a rule of the detector asks for the action; conditions on the typical value need one."""
    of = {"actual": actual, "typical": typical, "diff_from_typical": F.abs(actual - typical), "time": bucket}
    rules = [r for r in d.rules if action in r.actions and not r.scope]
    hit = [reduce(operator.and_, [COMPARE[c.operator](of[c.applies_to], F.lit(c.value)) for c in r.conditions], F.lit(True)) for r in rules]
    return reduce(operator.or_, hit, F.lit(False))


def detector_records(df: DataFrame, i: int, d: Detector, job: JobConfig, states: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(the records of one detector, the states of its series or None)."""
    if d.spec.value in REFUSED:
        raise ValueError(f"{d.function} has no series of numbers")
    values = features.feature_values(df, d, job.time_field, job.bucket_span, job.summary_count_field).withColumn("value", F.col("value").cast("double"))
    values = values.where(~F.coalesce(meets(d, "skip_model_update", F.col("value"), F.lit(None).cast("double"), F.col("bucket")), F.lit(False)))
    if d.over:
        scored, kept = models.population_scores(values, ["partition", "attribute"], "bucket", "value").withColumnRenamed("value", "actual"), None
    else:
        before = states.where(F.col("detector") == i).drop("detector") if states is not None else None
        scored, kept = series.series_scores(values, ["partition", "person"], "bucket", "value", job.bucket_span, states=before)
        scored, kept = scored.withColumn("attribute", F.lit("")), kept.withColumn("detector", F.lit(i))
    p = on_tail(F.col("probability"), F.col("actual"), F.col("typical"), d.spec.tail)
    skip = F.coalesce(meets(d, "skip_result", F.col("actual"), F.col("typical"), F.col("bucket")), F.lit(False))
    return scored.where(~skip).withColumn("detector", F.lit(i)).select(*KEYS, "actual", "typical", p.alias("probability")), kept


def run(df: DataFrame, job: JobConfig, states: DataFrame | None = None) -> Results:
    """The job over all events of df, going on from the states of an earlier run."""
    each = [detector_records(df, i, d, job, states) for i, d in enumerate(job.detectors)]
    records = written(*[r.withColumn("person", F.coalesce("person", F.lit(""))) for r, _ in each])
    held = [k.select("detector", "partition", "person", "state") for _, k in each if k is not None]
    none = df.sparkSession.createDataFrame([], "detector int, partition string, person string, state binary")
    kept = written(*held) if held else none
    # from records up: persons over detectors, partitions over persons, buckets over partitions
    persons = written(hierarchy.combined(records, ["bucket", "partition", "person"], "probability", "detectors"))
    partitions = written(hierarchy.combined(persons, ["bucket", "partition"], "probability", "people"))
    roots = hierarchy.combined(partitions, ["bucket"], "probability", "attributes")
    text = F.lit(None).cast("string")
    columns = ["level", "bucket", "partition", "person", "n", "probability", "score"]
    nodes = written(
        persons.withColumn("level", F.lit("person")).select(*columns),
        partitions.withColumn("level", F.lit("partition")).withColumn("person", text).select(*columns),
        roots.withColumn("level", F.lit("root")).withColumn("partition", text).withColumn("person", text).select(*columns),
    )
    dropped(persons, partitions)
    scored = hierarchy.ceilings(records.withColumn("score", X.anomaly_score("probability")), ["detector"], "score")
    return Results(scored.withColumn("severity", X.severity("normalised")), hierarchy.ceilings(nodes, ["level"], "score"), kept)
