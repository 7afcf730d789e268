"""From raw pitches to the handoff tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from diamondframe.constants import HitterThresholds, PitcherThresholds
from diamondframe.operators import profiles
from diamondframe.operators.lookups import first_stands, pitcher_arsenals
from diamondframe.operators.pitches import labelled_pitches, relevant_pitches
from diamondframe.operators.runs import run_expectancy
from diamondframe.operators.training import training_table
from diamondframe.session import written, written_together


def profile_tables(
    relevant: DataFrame,
    hitter: HitterThresholds = HitterThresholds(),
    pitcher: PitcherThresholds = PitcherThresholds(),
) -> dict[str, DataFrame]:
    """The profile tables and the lookups made from them, all written.

    One pass over the pitches for the hitters and one for the pitchers.
    """
    first = written_together(
        {
            "hitter_sums": profiles.hitter_sums(relevant),
            "ind_pitcher_sum": profiles.pitcher_profiles(
                profiles.pitcher_sums(relevant), pitcher
            ),
        }
    )
    pitchers = first["ind_pitcher_sum"]
    hitters = hitter_tables(first["hitter_sums"], hitter)
    second = written_together({**hitters, **lookup_tables(pitchers, hitters["ind_hitter_sum"])})
    return {**second, "ind_pitcher_sum": pitchers}


def hitter_tables(
    sums: DataFrame, thresholds: HitterThresholds = HitterThresholds()
) -> dict[str, DataFrame]:
    """Both hitter profiles from the written sums."""
    return {
        "ind_hitter_sum": profiles.hitter_profiles(sums, thresholds),
        "generic_hitter_sum": profiles.generic_hitter_profiles(sums),
    }


def lookup_tables(pitchers: DataFrame, hitters: DataFrame) -> dict[str, DataFrame]:
    """What a request is looked up in besides the profiles themselves."""
    return {"arsenals": pitcher_arsenals(pitchers), "first_stands": first_stands(hitters)}


def scoring_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Handoff tables, for instance read from files, completed by the written lookups."""
    if {"arsenals", "first_stands"} <= set(tables):
        return tables
    added = lookup_tables(tables["ind_pitcher_sum"], tables["ind_hitter_sum"])
    return {**tables, **written_together(added)}


def handoff_tables(
    pitches: DataFrame,
    hitter: HitterThresholds = HitterThresholds(),
    pitcher: PitcherThresholds = PitcherThresholds(),
) -> dict[str, DataFrame]:
    """All tables the later jobs read; ``model_data`` stays lazy until it is written."""
    relevant = relevant_pitches(pitches)
    profiled = profile_tables(relevant, hitter, pitcher)
    names = ["ind_hitter_sum", "generic_hitter_sum", "ind_pitcher_sum"]
    tables = {name: profiled[name] for name in names}
    tables["re288"] = written(run_expectancy(relevant), "re288")
    tables["model_data"] = training_table(
        labelled_pitches(relevant), tables["ind_hitter_sum"], tables["generic_hitter_sum"]
    )
    return tables
