"""Flight delays two hours ahead: raw tables → joined flights → features → models.

Tables in: flights, weather reports, stations, airport codes, and a zone (or fixed offset) per
station. Each step takes and returns DataFrames; ``run`` strings them together over stages on
shared storage, so that a step is done once and a lost one starts from the step before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadtime.functions.clock import HOUR, day_of_year, epoch_of, epoch_seconds, hhmm_to_minutes, local_epoch, shifted
from leadtime.functions.cyclic import cyclic
from leadtime.functions.keys import composite_key
from leadtime.operators import learn, metrics
from leadtime.operators.asof import asof_bucketed, asof_exact
from leadtime.operators.cleaning import clean_packed, keep_equal, require
from leadtime.operators.columns import feature_columns, loss_table, observed_losses, typed_select
from leadtime.operators.graph import flow_edges, flow_vertices, pagerank
from leadtime.operators.history import previous_outcome
from leadtime.operators.levels import fold_rare_levels
from leadtime.operators.lookup import keep_known, keys_in_use, looked_up, rank_features, station_zones, within_bounds
from leadtime.plans.training import Columns, Exploration, Final, Parts, explore, parts_of, train_boosting
from leadtime.sources.stages import current_stage, restage, save_model, stage_once, write_stage

# Names and types of the published flight and weather tables, the layout of packed
# weather fields, their codes for "missing", the codes of erroneous readings, the report type.
FLIGHT_TYPES = {
    "ORIGIN": "string",
    "ORIGIN_CITY_NAME": "string",
    "ORIGIN_AIRPORT_ID": "string",
    "DEST_AIRPORT_ID": "string",
    "OP_CARRIER_AIRLINE_ID": "string",
    "OP_CARRIER_FL_NUM": "string",
    "TAIL_NUM": "string",
    "DEP_TIME_BLK": "string",
    "ARR_TIME_BLK": "string",
    "CRS_DEP_TIME": "string",
    "CRS_ARR_TIME": "string",
    "CRS_ELAPSED_TIME": "float",
    "DISTANCE": "double",
    "DISTANCE_GROUP": "int",
    "QUARTER": "int",
    "MONTH": "int",
    "DAY_OF_MONTH": "int",
    "DAY_OF_WEEK": "int",
    "FL_DATE": "string",
    "DEP_DELAY": "float",
    "DEP_DEL15": "int",
}
REPORT_TYPE = "FM-15"
REPORT_TYPES = {
    "STATION": "string",
    "DATE": "timestamp",
    "LATITUDE": "double",
    "LONGITUDE": "double",
    "CALL_SIGN": "string",
    "WND": "string",
    "CIG": "string",
    "VIS": "string",
    "TMP": "string",
    "DEW": "string",
    "SLP": "string",
}
PACKED_LAYOUT = {
    "WND": ["WND_DIR_ANGLE", "WND_DIR_QUALITY", "WND_TYPE", "WND_SPEED_RATE", "WND_SPEED_QUALITY"],
    "CIG": ["CIG_HEIGHT_DIM", "CIG_QUALITY", "CIG_DETERMINATION", "CIG_CAVOK"],
    "VIS": ["VIS_DIS_DIM", "VIS_DIS_QUALITY", "VIS_VARIABILITY", "VIS_VARIABILITY_QUALITY"],
    "TMP": ["AIR_TMP", "AIR_TMP_QUALITY"],
    "DEW": ["DEW_POINT_TMP", "DEW_POINT_QUALITY"],
    "SLP": ["SLP_PSR", "SLP_PSR_QUALITY"],
}
MISSING = {
    "WND_DIR_ANGLE": "999",
    "WND_SPEED_RATE": "9999",
    "CIG_HEIGHT_DIM": "99999",
    "VIS_DIS_DIM": "999999",
    "AIR_TMP": "+9999",
    "DEW_POINT_TMP": "+9999",
    "SLP_PSR": "99999",
}
QUALITY = [
    "WND_DIR_QUALITY", "WND_SPEED_QUALITY", "CIG_QUALITY", "VIS_DIS_QUALITY",
    "AIR_TMP_QUALITY", "DEW_POINT_QUALITY", "SLP_PSR_QUALITY",
]
ERRONEOUS = ["3", "7"]
READING_TYPES = {
    "DATE": "timestamp",
    "STATION": "string",
    "CALL_SIGN": "string",
    "WND_DIR_ANGLE": "float",
    "WND_SPEED_RATE": "float",
    "CIG_HEIGHT_DIM": "float",
    "VIS_DIS_DIM": "float",
    "AIR_TMP": "float",
    "DEW_POINT_TMP": "float",
    "SLP_PSR": "float",
}

# Columns the models use, the codes for folded levels.
FEATURES = Columns(
    categoricals=[
        "DAY_OF_MONTH", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "OP_CARRIER_AIRLINE_ID",
        "TAIL_NUM_MOD", "OP_CARRIER_FL_NUM_MOD", "TAIL_NUM_PREV_DEP_DEL15",
    ],
    numericals=[
        "DISTANCE", "WND_SPEED_RATE", "CIG_HEIGHT_DIM", "VIS_DIS_DIM", "AIR_TMP", "SLP_PSR",
        "CRS_ARR_TIME_MINS_sin", "CRS_ARR_TIME_MINS_cos", "CRS_DEP_TIME_MINS_sin", "CRS_DEP_TIME_MINS_cos",
        "DAY_OF_YEAR_sin", "DAY_OF_YEAR_cos", "DAY_OF_WEEK_sin", "DAY_OF_WEEK_cos",
        "WND_DIR_ANGLE_sin", "WND_DIR_ANGLE_cos", "ORIGIN_AIRPORT_PAGERANK", "DEST_AIRPORT_PAGERANK",
    ],
    outcome="DEP_DEL15",
    time="AIRLINE_TIMESTAMP",
)
FOLDED = {"OP_CARRIER_FL_NUM": "99999", "TAIL_NUM": "TAIL99"}


def clean_flights(raw: DataFrame, losses: tuple[Observation, Observation] | None = None) -> DataFrame:
    """Typed flights with a known delay and duration, minutes of the day and departure in epoch seconds.

    ``losses`` count the values that casts and clock times turn into nulls: of the raw columns, and of what is derived.
    """
    flights = require(typed_select(raw, FLIGHT_TYPES, losses and losses[0]), ["DEP_DEL15", "DEP_DELAY", "CRS_ELAPSED_TIME"])
    if losses:
        departure = F.concat("FL_DATE", "CRS_DEP_TIME")
        derived = {
            "CRS_DEP_TIME_MINS": (F.col("CRS_DEP_TIME"), hhmm_to_minutes(F.col("CRS_DEP_TIME"))),
            "CRS_ARR_TIME_MINS": (F.col("CRS_ARR_TIME"), hhmm_to_minutes(F.col("CRS_ARR_TIME"))),
            "AIRLINE_TIMESTAMP": (departure, epoch_of(F.col("FL_DATE"), F.col("CRS_DEP_TIME"))),
        }
        flights = observed_losses(flights, derived, losses[1])
    return flights.withColumns(
        {
            "CRS_DEP_TIME_MINS": hhmm_to_minutes(F.col("CRS_DEP_TIME")),
            "CRS_ARR_TIME_MINS": hhmm_to_minutes(F.col("CRS_ARR_TIME")),
            "AIRLINE_TIMESTAMP": epoch_of(F.col("FL_DATE"), F.col("CRS_DEP_TIME")),
            "AIRLINE_ID": composite_key(
                *map(
                    F.col,
                    [
                        "OP_CARRIER_AIRLINE_ID", "OP_CARRIER_FL_NUM", "TAIL_NUM", "ORIGIN_AIRPORT_ID",
                        "DEST_AIRPORT_ID", "FL_DATE", "CRS_DEP_TIME",
                    ],
                )
            ),
        }
    )


def clean_reports(raw: DataFrame) -> DataFrame:
    """Routine reports with all seven readings present and sound, as numbers."""
    reports = typed_select(keep_equal(raw, "REPORT_TYPE", REPORT_TYPE), REPORT_TYPES)
    sound = clean_packed(reports, PACKED_LAYOUT, MISSING, QUALITY, trim=["CALL_SIGN"], codes=ERRONEOUS)
    return typed_select(sound, READING_TYPES)


def with_call(flights: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the call sign of the origin from the ``ORIGIN`` → ``CALL`` table."""
    return looked_up(flights, "ORIGIN", codes, "ORIGIN", {"CALL": "AIRLINE_CALL"})


def local_readings(reports: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings of the given stations at local wall-clock seconds.

    ``stations`` has ``station`` and either ``zone``, an IANA name, or ``offset``, minutes from UTC.
    """
    if "zone" in stations.columns:
        given, at = "zone", lambda c: local_epoch(F.col("DATE"), c)
    else:
        given, at = "offset", lambda c: shifted(epoch_seconds(F.col("DATE")), c)
    placed = looked_up(reports, "STATION", stations, "station", {given: "__given"}, "inner")
    return placed.withColumn("WEATHER_TIMESTAMP", at(F.col("__given"))).drop("__given")


def with_weather(flights: DataFrame, readings: DataFrame, *, exact: bool = False) -> DataFrame:
    """Each flight with the latest reading at its origin's call sign, two hours old or more.

    The nearest-hour form finds ages of two to three hours and part of the next hour; ``exact``
    finds all from two to four.
    """
    useful = within_bounds(readings, "WEATHER_TIMESTAMP", flights, "AIRLINE_TIMESTAMP", 4 * HOUR)
    left = flights.withColumn("CALL_SIGN", F.col("AIRLINE_CALL"))
    tie = [c for c in useful.columns if c not in ("CALL_SIGN", "WEATHER_TIMESTAMP")]
    sides = (left, useful, "CALL_SIGN", "AIRLINE_TIMESTAMP", "WEATHER_TIMESTAMP", tie)
    if exact:
        return asof_exact(*sides, min_age=2 * HOUR, max_age=4 * HOUR, age="TIME_DIFF")
    return asof_bucketed(*sides, age="TIME_DIFF")


def with_cycles(df: DataFrame) -> DataFrame:
    """Times and directions as sines and cosines; the minutes themselves go."""
    cycles = {
        "CRS_ARR_TIME_MINS": (F.col("CRS_ARR_TIME_MINS"), "TIME"),
        "CRS_DEP_TIME_MINS": (F.col("CRS_DEP_TIME_MINS"), "TIME"),
        "MONTH": (F.col("MONTH"), "MTH"),
        "DAY_OF_YEAR": (day_of_year(F.col("FL_DATE")), "DOY"),
        "DAY_OF_WEEK": (F.col("DAY_OF_WEEK"), "DOW"),
        "WND_DIR_ANGLE": (F.col("WND_DIR_ANGLE").cast("int"), "WND"),
    }
    added = {}
    for name, (value, period) in cycles.items():
        added[f"{name}_sin"], added[f"{name}_cos"] = cyclic(value, period)
    return df.withColumns(added).drop("CRS_ARR_TIME_MINS", "CRS_DEP_TIME_MINS")


def airport_ranks(flights: DataFrame) -> DataFrame:
    """PageRank of every airport of departure; flights between two airports count as often as they are flown."""
    edges = flow_edges(flights, "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID")
    return pagerank(edges, flow_vertices(flights, "ORIGIN_AIRPORT_ID"))


def proposed_features(joined: DataFrame, ranks: DataFrame) -> DataFrame:
    """The model inputs from joined flights. ``joined`` should be a stage: it is read several times."""
    df = joined
    for column, code in FOLDED.items():
        df = fold_rare_levels(df, column, f"{column}_MOD", code)
    df = previous_outcome(
        with_cycles(df),
        "TAIL_NUM",
        "AIRLINE_TIMESTAMP",
        "DEP_DEL15",
        "AIRLINE_ID",
        flag="TAIL_NUM_PREV_DEP_DEL15",
        previous_time="TAIL_NUM_PREV_TIMESTAMP",
    )
    df = rank_features(
        df,
        ranks,
        {"ORIGIN_AIRPORT_ID": "ORIGIN_AIRPORT_PAGERANK", "DEST_AIRPORT_ID": "DEST_AIRPORT_PAGERANK"},
    )
    return feature_columns(df, FEATURES.categoricals, FEATURES.numericals, [FEATURES.time], FEATURES.outcome)


@dataclass(frozen=True)
class Sources:
    """Raw tables. ``zones``: ``station`` and ``zone`` or ``offset``; ``codes``: ``ORIGIN`` and ``CALL``."""

    flights: DataFrame
    weather: DataFrame
    stations: DataFrame
    codes: DataFrame
    zones: DataFrame
    min_date: int


def joined_flights(sources: Sources, *, flights: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Clean flights with the weather known two hours before departure.

    ``flights`` are the clean ones if they have been written already: they are read several times.
    """
    flights = clean_flights(sources.flights) if flights is None else flights
    codes = keys_in_use(sources.codes, "ORIGIN", flights, "ORIGIN")
    located = [c for c in ("zone", "offset") if c in sources.zones.columns][:1]
    stations = station_zones(
        sources.stations,
        codes.select(F.col("CALL").alias("call")),
        sources.zones,
        sources.min_date,
        columns=located,
    )
    readings = local_readings(clean_reports(sources.weather), stations)
    at_origins = keep_known(readings, "CALL_SIGN", codes, "CALL")
    return with_weather(with_call(flights, codes), at_origins, exact=exact)


# Names under which stages and models are kept.
RANKS, CLEAN, LOST, ORIGINAL, PROPOSED = "pageranks", "flights", "lost_values", "original", "proposed_features"
REDUCED = ["reduced_trainingData", "reduced_valData", "reduced_testData"]


@dataclass
class Outcome:
    """The tuned model with its trials and scored test rows, and what they are worth."""

    final: Final
    areas: DataFrame
    accuracy: DataFrame
    confusion: DataFrame
    classes: DataFrame
    curves: DataFrame
    importances: DataFrame


def evaluated(spark: SparkSession, final: Final) -> Outcome:
    """Areas, accuracy, confusion, metrics by class and curve points of the scored test part, and the features' importances."""
    scored = final.predictions
    slots = [a["name"] for a in learn.vector_attributes(final.model.transform(final.test), "features")]
    weights = final.model.stages[-1].featureImportances.toArray()
    ranked = spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(zip(slots, weights))], "idx int, name string, score double")
    return Outcome(
        final,
        metrics.curve_areas(scored),
        metrics.accuracy(scored),
        metrics.confusion(scored),
        metrics.class_metrics(scored),
        metrics.curve_points(scored),
        ranked.orderBy(F.desc("score"), "idx"),
    )


def shape_of(sources: Sources, *, exact: bool, oversample: str | None = None) -> str:
    """Part of a stage's name that tells by which parameters it was made."""
    return "_".join([f"from{sources.min_date}", "exact" if exact else "bucketed", *([oversample] if oversample else [])])


def prepared(spark: SparkSession, sources: Sources, root: str, scope: str, *, every_flight: DataFrame | None, exact: bool) -> DataFrame:
    """The feature stage of a scope; what is there already, made by the same parameters from unchanged inputs, is taken as it is.

    Ranks come from ``every_flight``, the flights of the full range, whatever the scope; without
    them, from those of the scope, and are then kept with the scope. Beside the clean flights lies how many values cleaning lost, by column. A source that is None is not asked
    whether it has changed. Joined flights and features are laid out by time, so that the parts' range filters skip files.
    """
    whole = every_flight is not None
    ranked = every_flight if whole else sources.flights
    ranks = stage_once(spark, root, "all" if whole else scope, RANKS, lambda: airport_ranks(ranked), inputs=[ranked])
    shape, parameters = shape_of(sources, exact=exact), {"min_date": sources.min_date, "exact": exact}
    losses = (Observation(), Observation())
    was = current_stage(spark, root, scope, CLEAN)
    flights = stage_once(spark, root, scope, CLEAN, lambda: clean_flights(sources.flights, losses), inputs=[sources.flights])
    if current_stage(spark, root, scope, CLEAN) != was:
        write_stage(loss_table(spark, losses[0]).union(loss_table(spark, losses[1])), root, scope, LOST)
    joined = stage_once(
        spark, root, scope, f"{ORIGINAL}_{shape}", lambda: joined_flights(sources, flights=flights, exact=exact),
        parameters=parameters, inputs=[flights, sources.weather, sources.stations, sources.codes, sources.zones], cluster_by=FEATURES.time,
    )
    return stage_once(
        spark, root, scope, f"{PROPOSED}_{shape}", lambda: proposed_features(joined, ranks),
        parameters=parameters, inputs=[joined, ranks], cluster_by=FEATURES.time,
    )


def tried(
    spark: SparkSession,
    sources: Sources,
    root: str,
    scope: str,
    *,
    every_flight: DataFrame | None = None,
    exact: bool = False,
    oversample: str = "train",
) -> Exploration:
    """Every kind of model tried on a scope; the chosen ones are saved and the reduced parts written.

    Both lie under names that tell the parameters, so runs with others leave them alone.
    """
    features = prepared(spark, sources, root, scope, every_flight=every_flight, exact=exact)
    place = f"{scope}/{shape_of(sources, exact=exact, oversample=oversample)}"
    parts = parts_of(features, FEATURES, oversample=oversample).staged(root, place)

    def keep(reduced: Parts) -> None:
        for name, frame in zip(REDUCED, (reduced.train, reduced.val, reduced.test)):
            restage(frame, root, place, name)

    found = explore(parts, FEATURES, keep=keep)
    for name, model in found.models.items():
        save_model(model, root, f"{place}/{name.replace(' ', '_')}")
    return found


def run(
    spark: SparkSession,
    sources: Sources,
    root: str,
    scope: str,
    *,
    every_flight: DataFrame | None = None,
    exact: bool = False,
    oversample: str = "train",
) -> Outcome:
    """All steps; stages already written under ``root/scope`` by the same parameters from unchanged inputs are taken as they are.

    Returns the tuned model with its trials and the scored test part, which are saved as well, and
    its evaluation.
    """
    features = prepared(spark, sources, root, scope, every_flight=every_flight, exact=exact)
    place = f"{scope}/{shape_of(sources, exact=exact, oversample=oversample)}"
    parts = parts_of(features, FEATURES, oversample=oversample).staged(root, place)
    final = train_boosting(parts, FEATURES)
    save_model(final.model, root, f"{place}/boosting")
    scored = restage(
        final.predictions.select("label", "rawPrediction", "probability", "prediction"), root, place, "predictions"
    )
    return evaluated(spark, Final(final.model, final.trials, metrics.scored(scored), parts.test))
