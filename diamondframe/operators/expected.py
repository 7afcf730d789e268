"""Expected runs of a candidate and the best candidate of a request."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from diamondframe import constants as K
from diamondframe.functions.states import state_key
from diamondframe.functions.transitions import apply_event

TYPE = "pitch_type_condensed"
#: Bits of a target's number on one axis, in the rank of a candidate.
TARGET_BITS = 5


def outcome_frequencies(
    labelled: DataFrame, by: list[str], labels: list[str]
) -> DataFrame:
    """Observed share of each outcome per group, as ``probs`` in label order.

    The simplest source of probabilities; a fitted model is the other.
    """
    shares = [
        F.count_if(F.col("events") == label).cast("double")
        / F.count(F.lit(1)).cast("double")
        for label in labels
    ]
    known = labelled.filter(F.col("events").isNotNull())
    return known.groupBy(*by).agg(F.array(*shares).alias("probs"))


def all_states(spark) -> DataFrame:
    """The 288 states of an inning: outs, bases and count."""
    number = F.col("id").cast("int")
    parts = {
        "outs": F.floor(number / 96),
        "b1": F.floor(number / 48) % 2,
        "b2": F.floor(number / 24) % 2,
        "b3": F.floor(number / 12) % 2,
        "balls": F.floor(number / 3) % 4,
        "strikes": number % 3,
    }
    states = spark.range(288).select(*[c.cast("int").alias(n) for n, c in parts.items()])
    return states.withColumn("state", state_key(*[F.col(n) for n in parts]))


def next_state_values(
    expectancy: DataFrame, labels: list[str], include_event_runs: bool = False
) -> DataFrame:
    """Per state, the expected runs after each outcome, as an array in label order.

    Three outs are worth nothing; a next state missing from the expectancy table is null.
    Runs scored by the outcome itself count only with ``include_event_runs``.
    """
    outcome = F.posexplode(F.array(*[F.lit(label) for label in labels]))
    moved = apply_event(
        all_states(expectancy.sparkSession).select("*", outcome.alias("label", "events"))
    )
    table = expectancy.select(
        F.col("out_base_count_state").alias("next_state"), "runs_expected"
    )
    inning_over = F.col("next_outs") == K.OUTS_PER_INNING
    value = F.when(inning_over, 0.0).otherwise(F.col("runs_expected"))
    if include_event_runs:
        value = value + F.col("runs_scored")
    valued = moved.join(table, "next_state", "left").withColumn("value", value)
    in_order = F.sort_array(F.collect_list(F.struct("label", "value")))
    return valued.groupBy("state").agg(in_order["value"].alias("next_values"))


def with_next_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Attach the values of the request's state; 288 rows by construction, so broadcast."""
    return rows.join(F.broadcast(values), "state", "left")


def expected_runs(rows: DataFrame, labels: list[str], probs: str = "probs") -> DataFrame:
    """Sum of probability times value over the outcomes, within the row.

    Null as soon as one outcome leads to a state without a value.
    """
    terms = [
        F.get(F.col(probs), F.lit(i)) * F.get(F.col("next_values"), F.lit(i))
        for i in range(len(labels))
    ]
    return rows.withColumn("expected_runs", reduce(add, terms))


def best_pitch(candidates: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The candidate with the fewest expected runs, per request.

    Equal values go to the first pitch type, then target. Values are compared to nine
    decimals so that the choice does not hang on the order of a sum. Candidates without
    a value, or of a type that is none of the seven, cannot be chosen.

    Value, type and target are packed into one number that keeps their order, so the minimum
    is a hash aggregate over numbers and no candidate is sorted. ``keep`` names the columns of
    the result: the type, columns of numbers, and arrays of a number per outcome.
    """
    keep = keep or [TYPE, "x_idx", "z_idx", "plate_x", "plate_z", "expected_runs"]
    kinds = dict(candidates.dtypes)
    arrays = {c: len(K.KEPT_EVENTS) for c in keep if kinds[c] == "array<double>"}
    numbers = {f"_{c}_{i}": F.get(c, F.lit(i)) for c, n in arrays.items() for i in range(n)}
    flat = candidates.withColumns(numbers) if numbers else candidates
    names = [c for c in keep if c != TYPE and c not in arrays] + list(numbers)
    # A missing value makes a missing number, which no minimum takes. A filter up front would be
    # pushed below the model and evaluate it once more for every outcome.
    best = flat.withColumn("_rank", _rank()).groupBy("request_id").agg(
        F.min("_rank").alias("_best"), *[F.min_by(n, "_rank").alias(n) for n in names]
    )
    kind = F.get(_types(), F.shiftright("_best", 2 * TARGET_BITS).bitwiseAND(7).cast("int") - 1)
    made = {TYPE: kind} | {
        c: F.when(F.col(f"_{c}_0").isNotNull(), F.array(*[F.col(f"_{c}_{i}") for i in range(n)]))
        for c, n in arrays.items()
    }
    chosen = best.filter(F.col("_best").isNotNull())
    return chosen.select("request_id", *[made.get(c, F.col(c)).alias(c) for c in keep])


def _types() -> Column:
    return F.array(*[F.lit(t) for t in sorted(K.PITCH_TYPES)])


def _rank() -> Column:
    """Expected runs to nine decimals, then type, then target, as one number in their order."""
    value = F.round(F.round("expected_runs", 9) * 1e9).cast("long")
    number = F.nullif(F.array_position(_types(), F.col(TYPE)), F.lit(0).cast("long"))
    for bits, part in ((3, number), (TARGET_BITS, F.col("x_idx")), (TARGET_BITS, F.col("z_idx"))):
        value = value * (1 << bits) + part
    return value
