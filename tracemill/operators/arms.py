"""Arms of an experiment: serving counters, wall time, and comparison with a reference arm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the serving engine; each has a name with a colon, and an older one with an underscore.
COUNTERS = {
    "prompt_tokens": "prompt_tokens_total",
    "prefix_queries": "prefix_cache_queries_total",
    "prefix_hits": "prefix_cache_hits_total",
    "requests": "request_success_total",
    **{f"{short}_{end}": f"{name}_seconds_{end}" for short, name in (("ttft", "time_to_first_token"), ("prefill", "request_prefill_time"), ("e2e", "e2e_request_latency")) for end in ("sum", "count")},
}
#: Measures that are compared: (source, whether as a ratio, what has to be complete on both sides).
COMPARED = {
    "api_calls_delta": ("api_calls", False, "base"),
    "prompt_token_ratio": ("prompt_tokens", True, "usage"),
    "uncached_prompt_token_ratio": ("uncached_prompt_tokens", True, "cache"),
    "wall_time_ratio": ("wall_time_seconds", True, "base"),
    "prefix_hit_ratio_delta": ("prefix_hit_ratio", False, "vllm"),
    "prefill_time_ratio": ("prefill_sum", True, "vllm"),
    "ttft_ratio": ("ttft_sum", True, "vllm"),
    "e2e_latency_ratio": ("e2e_sum", True, "vllm"),
    "resolve_rate_delta": ("resolve_rate", False, "grade"),
}


def ratio(total: Column, count: Column) -> Column:
    """total / count; null if either is, or count is 0."""
    return F.try_divide(total, F.nullif(count, F.lit(0)))


def serving_metrics(samples: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, available, deltas, means) of samples (arm, phase 'before' or 'after', name, value).

    Values of one name are summed over labels; those that aren't finite don't
    count.  Of a counter's two names the first that both phases have is taken; a
    counter that went down has no delta.
    """
    fine = samples.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")

    def total(phase: str, name: str) -> Column:
        return F.sum(F.when((F.col("phase") == phase) & (F.col("name") == name), F.col("value")))

    sums = {f"{c}_{k}_{p}": total(p, f"vllm{mark}{name}") for c, name in COUNTERS.items() for k, mark in enumerate(":_") for p in ("before", "after")}
    x = fine.groupBy(arm).agg(F.count_if(F.col("phase") == "before").alias("n_before"), F.count_if(F.col("phase") == "after").alias("n_after"), *(v.alias(k) for k, v in sums.items()))

    def delta(c: str) -> Column:
        both = [(F.col(f"{c}_{k}_before"), F.col(f"{c}_{k}_after")) for k in (0, 1)]
        d = reduce(lambda rest, ba: F.when(ba[0].isNotNull() & ba[1].isNotNull(), ba[1] - ba[0]).otherwise(rest), reversed(both), F.lit(None).cast("double"))
        return F.when(d >= 0, d)

    x = x.select(arm, ((F.col("n_before") > 0) & (F.col("n_after") > 0)).alias("available"), *(delta(c).alias(c) for c in COUNTERS))
    means = {"prefix_hit_ratio": ("prefix_hits", "prefix_queries"), **{f"{s}_mean": (f"{s}_sum", f"{s}_count") for s in ("ttft", "prefill", "e2e")}}
    return x.select("*", *(ratio(F.col(a), F.col(b)).alias(k) for k, (a, b) in means.items()))


def wall_time(started: Column, ended: Column) -> Column:
    """Seconds between two ISO times, 0 at least; null if one is missing."""
    micros = F.unix_micros(F.try_to_timestamp(ended)) - F.unix_micros(F.try_to_timestamp(started))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0.0), micros / 1e6))


def compare(arms: DataFrame, reference: str, arm: str = "arm") -> DataFrame:
    """(arm, measures of COMPARED) against the reference arm; a measure is null where the two can't be compared.

    Both arms must have run to the end without an error, with a prediction and a
    submission of every task, over the same tasks; token, cache, serving and
    grading measures need their own telemetry on both sides besides.
    """
    ref = arms.where(F.col(arm) == reference).limit(1)
    ref = ref.select(*(F.col(c).alias(f"ref_{c}") for c in ref.columns))
    x = arms.join(F.broadcast(ref), F.lit(True), "left")
    done = lambda p: (F.col(f"{p}exit_code") == 0) & F.col(f"{p}completed") & (F.col(f"{p}predictions") == F.col(f"{p}trajectories")) & F.col(f"{p}all_submitted") & (F.col(f"{p}prediction_ids") == F.col(f"{p}trajectory_ids"))
    base = F.coalesce((F.col("ref_trajectories") > 0) & done("") & done("ref_") & (F.col("prediction_ids") == F.col("ref_prediction_ids")) & (F.col("trajectory_ids") == F.col("ref_trajectory_ids")), F.lit(False))
    both = lambda c: F.coalesce(F.col(c) & F.col(f"ref_{c}"), F.lit(False))
    gates = {
        "base": base,
        "usage": base & both("usage_complete"),
        "cache": base & both("cache_complete"),
        "vllm": base & both("available") & both("isolated"),
        "grade": base & F.coalesce((F.col("graded") == F.col("trajectories")) & (F.col("ref_graded") == F.col("ref_trajectories")), F.lit(False)),
    }
    value = lambda c, is_ratio: ratio(F.col(c), F.col(f"ref_{c}")) if is_ratio else F.col(c) - F.col(f"ref_{c}")
    return x.select(arm, base.alias("comparable"), *(F.when(gates[gate], value(c, is_ratio)).cast("double").alias(k) for k, (c, is_ratio, gate) in COMPARED.items()))
