"""Job configurations: detectors, their grammar and the rules that go with them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from driftwell.functions.expressions import parse_duration


@dataclass(frozen=True)
class Function:
    """A detector function: how its bucket value is made and which tail of its distribution is unusual."""

    name: str
    value: str
    tail: str = "two_sided"
    field: bool = False  # needs field_name
    individual: bool = True
    population: bool = True
    zero_fill: bool = False  # empty buckets count as zero for known persons


def _family(base: str, value: str, *, aliases: tuple[str, ...] = (), **kw) -> dict[str, Function]:
    """The function and its low_ and high_ variants, each under all its names."""
    out = {}
    for prefix, tail in (("", "two_sided"), ("low_", "low"), ("high_", "high")):
        f = Function(prefix + base, value, tail, **kw)
        out |= {prefix + n: f for n in (base, *aliases)}
    return out


# The names that configurations use.
FUNCTIONS: dict[str, Function] = (
    _family("count", "count", aliases=("c",), zero_fill=True)
    | _family("non_zero_count", "count", aliases=("nzc",), population=False)
    | _family("distinct_count", "distinct", aliases=("dc",), field=True)
    | _family("info_content", "info_content", field=True)
    | _family("mean", "mean", aliases=("avg",), field=True)
    | _family("median", "median", field=True)
    | _family("varp", "varp", field=True)
    | _family("sum", "sum", field=True, zero_fill=True)
    | _family("non_null_sum", "sum", aliases=("nns",), field=True, population=False)
    | {
        n: f
        for names, f in (
            (("rare",), Function("rare", "rare", "low")),
            (("rare_non_zero_count", "rnzc"), Function("rare_non_zero_count", "rare", "low", population=False)),
            (("rare_count",), Function("rare_count", "rare_count", "low", individual=False)),
            (("freq_rare", "fr"), Function("freq_rare", "freq_rare", "low", individual=False)),
            (("freq_rare_count", "frc"), Function("freq_rare_count", "freq_rare_count", "low", individual=False)),
            (("time_of_day",), Function("time_of_day", "time_of_day")),
            (("time_of_week",), Function("time_of_week", "time_of_week")),
            (("metric",), Function("metric", "metric", field=True)),
            (("min",), Function("min", "min", "low", field=True)),
            (("max",), Function("max", "max", "high", field=True)),
            (("lat_long",), Function("lat_long", "lat_long", field=True)),
            (("max_velocity",), Function("max_velocity", "max", "high", field=True)),
            (("min_velocity",), Function("min_velocity", "min", "low", field=True)),
            (("mean_velocity",), Function("mean_velocity", "mean", field=True)),
            (("sum_velocity",), Function("sum_velocity", "sum", field=True, zero_fill=True)),
        )
        for n in names
    }
)


@dataclass(frozen=True)
class Condition:
    applies_to: str  # actual, typical, diff_from_typical, time
    operator: str  # lt, lte, gt, gte
    value: float


@dataclass(frozen=True)
class Rule:
    actions: tuple[str, ...] = ("skip_result",)
    conditions: tuple[Condition, ...] = ()
    scope: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # field -> (include | exclude, patterns)


@dataclass(frozen=True)
class Detector:
    function: str
    field_name: str | None = None
    by: str | None = None
    over: str | None = None
    partition: str | None = None
    use_null: bool = False
    exclude_frequent: str = "none"
    rules: tuple[Rule, ...] = ()

    def __post_init__(self):
        f = FUNCTIONS.get(self.function)
        if f is None:
            raise ValueError(f"unknown function {self.function!r}")
        if f.field and not self.field_name:
            raise ValueError(f"{self.function} needs a field name")
        if not f.field and self.field_name:
            raise ValueError(f"{self.function} takes no field name")
        if self.over and not f.population:
            raise ValueError(f"{self.function} takes no over field")
        if not self.over and not f.individual:
            raise ValueError(f"{self.function} needs an over field")
        if self.function in ("rare", "rare_non_zero_count", "rnzc", "freq_rare", "fr", "freq_rare_count", "frc", "rare_count") and not self.by:
            raise ValueError(f"{self.function} needs a by field")
        names = [n for n in (self.by, self.over, self.partition) if n]
        if len(set(names)) < len(names):
            raise ValueError("by, over and partition fields must differ")
        if self.exclude_frequent not in ("none", "by", "over", "all"):
            raise ValueError(f"exclude_frequent {self.exclude_frequent!r}")

    @property
    def spec(self) -> Function:
        return FUNCTIONS[self.function]


@dataclass(frozen=True)
class JobConfig:
    detectors: tuple[Detector, ...]
    bucket_span: int = 300
    latency: int = 0
    time_field: str = "time"
    influencers: tuple[str, ...] = ()
    summary_count_field: str | None = None
    categorization_field: str | None = None
    prune_window: int | None = None


DETECTOR_KEYS = {
    "function": "function", "field_name": "field_name", "by_field_name": "by", "over_field_name": "over",
    "partition_field_name": "partition", "use_null": "use_null", "exclude_frequent": "exclude_frequent",
    "custom_rules": "rules", "detector_description": None, "detector_index": None,
}


def read_rule(d: dict) -> Rule:
    return Rule(
        tuple(d.get("actions", ("skip_result",))),
        tuple(Condition(c["applies_to"], c["operator"], float(c["value"])) for c in d.get("conditions", ())),
        {k: (v.get("filter_type", "include"), tuple(v.get("items", ()))) for k, v in d.get("scope", {}).items()},
    )


def read_job(text: str | dict) -> JobConfig:
    """A job from its JSON form; unknown detector keys and bad values raise ValueError."""
    d = json.loads(text) if isinstance(text, str) else text
    analysis = d.get("analysis_config", d)
    detectors = []
    for x in analysis.get("detectors", ()):
        if unknown := set(x) - set(DETECTOR_KEYS):
            raise ValueError(f"unknown detector keys {sorted(unknown)}")
        kept = {DETECTOR_KEYS[k]: v for k, v in x.items() if DETECTOR_KEYS[k] and v is not None}
        kept["rules"] = tuple(map(read_rule, kept.get("rules", ())))
        detectors.append(Detector(**kept))
    if not detectors:
        raise ValueError("a job needs a detector")
    return JobConfig(
        tuple(detectors),
        parse_duration(analysis.get("bucket_span", "5m")),
        parse_duration(analysis.get("latency", 0) or 0),
        d.get("data_description", {}).get("time_field", "time"),
        tuple(analysis.get("influencers", ())),
        analysis.get("summary_count_field_name"),
        analysis.get("categorization_field_name"),
        parse_duration(analysis["model_prune_window"]) if analysis.get("model_prune_window") else None,
    )


# Parameters of data-frame analyses and their defaults; None: no default, computed or absent.
ANALYSES: dict[str, dict[str, object]] = {
    "outlier_detection": {
        "standardization_enabled": True, "n_neighbors": 0, "method": "ensemble", "compute_feature_influence": True,
        "feature_influence_threshold": 0.1, "outlier_fraction": 0.05,
    },
    "regression": {"dependent_variable": None, "loss_function": "mse", "loss_function_parameter": None, "num_top_feature_importance_values": 0, "max_trees": 50, "max_depth": 5, "training_percent": 100.0},
    "classification": {"dependent_variable": None, "num_classes": 2, "num_top_classes": 2, "class_assignment_objective": "maximize_minimum_recall", "num_top_feature_importance_values": 0, "max_trees": 50, "max_depth": 5, "training_percent": 100.0},
}


def read_analysis(text: str | dict) -> tuple[str, dict[str, object]]:
    """(analysis name, parameters with defaults filled in); unknown or missing ones raise ValueError."""
    d = json.loads(text) if isinstance(text, str) else text
    name, given = d["analysis"]["name"], d["analysis"].get("parameters", {})
    if name not in ANALYSES:
        raise ValueError(f"unknown analysis {name!r}")
    known = ANALYSES[name]
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if "dependent_variable" in known and not given.get("dependent_variable"):
        raise ValueError("dependent_variable is missing")
    return name, known | given
