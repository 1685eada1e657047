"""The flight flow on a small made-up season."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.ml import PipelineModel

from leadtime.operators import learn
from leadtime.plans import flights as plan
from leadtime.sources.stages import load_model, read_stage, stage_exists

AIRPORTS = {"AAA": ("1", "KAAA", "72500000001"), "BBB": ("2", "KBBB", "72500000002"), "CCC": ("3", "KCCC", "72500000003")}
START = datetime(2015, 1, 1)


def season(days=12):
    """Planes fly round trips; the wind of the morning decides about delays."""
    rng = random.Random(21)
    flights, weather = [], []
    for day in range(days):
        date = START + timedelta(days=day)
        for origin, (airport, _, _) in AIRPORTS.items():
            for hhmm in ("600", "0905", "1410", "2355"):
                for n in range(3):
                    dest = rng.choice([a for a in AIRPORTS if a != origin])
                    late = int((day + int(airport)) % 4 == 0 or rng.random() < 0.1)
                    flights.append(
                        (origin, f"{origin} City", airport, AIRPORTS[dest][0], "19790", str(100 + n), f"N{n}{airport}",
                         "x", "x", hhmm, "1200", "95.0", "300.0", "2", "1", "1", str(date.day),
                         str(date.isoweekday()), date.strftime("%Y-%m-%d"), str(30.0 * late), str(late))
                    )
    for day in range(-1, days + 1):
        for hour in range(24):
            utc = START + timedelta(days=day, hours=hour, minutes=53)
            for airport, call, station in AIRPORTS.values():
                speed = "0150" if (day + int(airport)) % 4 == 0 else "0030"
                weather.append(
                    ("FM-15", station, utc, 40.0, -75.0, f"{call} ", f"160,1,N,{speed},1", "22000,1,9,N",
                     "016093,1,N,1", f"+0{100 + hour},1", "+0010,1", "10150,1")
                )
    flights.append(flights[0][:-2] + (None, None))
    weather.append(("FM-12", *weather[0][1:]))
    weather.append((*weather[0][:6], "999,1,N,0030,1", *weather[0][7:]))
    return flights, weather


FLIGHT_NAMES = [
    "ORIGIN", "ORIGIN_CITY_NAME", "ORIGIN_AIRPORT_ID", "DEST_AIRPORT_ID", "OP_CARRIER_AIRLINE_ID", "OP_CARRIER_FL_NUM",
    "TAIL_NUM", "DEP_TIME_BLK", "ARR_TIME_BLK", "CRS_DEP_TIME", "CRS_ARR_TIME", "CRS_ELAPSED_TIME", "DISTANCE",
    "DISTANCE_GROUP", "QUARTER", "MONTH", "DAY_OF_MONTH", "DAY_OF_WEEK", "FL_DATE", "DEP_DELAY", "DEP_DEL15",
]


@pytest.fixture(scope="module")
def sources(spark):
    flights, weather = season()
    return plan.Sources(
        flights=spark.createDataFrame(flights, ", ".join(f"{n} string" for n in FLIGHT_NAMES)),
        weather=spark.createDataFrame(
            weather,
            "REPORT_TYPE string, STATION string, DATE timestamp, LATITUDE double, LONGITUDE double, CALL_SIGN string, "
            "WND string, CIG string, VIS string, TMP string, DEW string, SLP string",
        ),
        stations=spark.createDataFrame(
            [(s[:6], s[6:], call, "40.0", "-75.0", "20200101") for _, call, s in AIRPORTS.values()],
            "usaf string, wban string, call string, lat string, lon string, end string",
        ),
        codes=spark.createDataFrame([(o, call) for o, (_, call, _) in AIRPORTS.items()], "ORIGIN string, CALL string"),
        zones=spark.createDataFrame(
            [(s, "America/New_York") for _, _, s in AIRPORTS.values()], "station string, zone string"
        ),
        min_date=20150101,
    )


def local_seconds(text):
    return int(datetime.strptime(text, "%Y-%m-%d %H%M").replace(tzinfo=timezone.utc).timestamp())


def test_each_flight_gets_the_latest_known_reading(sources):
    joined = plan.joined_flights(sources, exact=True).collect()
    flights, _ = season()
    assert len(joined) == len(flights) - 1
    for r in joined:
        assert r.AIRLINE_TIMESTAMP == local_seconds(f"{r.FL_DATE} {r.CRS_DEP_TIME.zfill(4)}")
        # A report every hour at 53 past, New York time in winter.
        latest = (r.AIRLINE_TIMESTAMP - 7200 - 53 * 60) // 3600 * 3600 + 53 * 60
        assert r.WEATHER_TIMESTAMP == latest and r.TIME_DIFF == r.AIRLINE_TIMESTAMP - latest
        assert r.AIRLINE_CALL == AIRPORTS[r.ORIGIN][1] == r.CALL_SIGN
    near = {(r.AIRLINE_ID, r.TIME_DIFF) for r in plan.joined_flights(sources).collect()}
    assert near == {(r.AIRLINE_ID, r.TIME_DIFF) for r in joined}


def test_offsets_in_place_of_zones(spark, sources):
    offsets = spark.createDataFrame([(s, -300) for _, _, s in AIRPORTS.values()], "station string, offset int")
    fixed = plan.joined_flights(plan.Sources(**{**sources.__dict__, "zones": offsets}))
    assert sorted(r.TIME_DIFF for r in fixed.select("TIME_DIFF").collect()) == sorted(
        r.TIME_DIFF for r in plan.joined_flights(sources).select("TIME_DIFF").collect()
    )


def test_whole_flow(spark, sources, tmp_path, monkeypatch):
    monkeypatch.setattr(learn, "BOOSTING_GRID", {"maxDepth": [3], "stepSize": [0.3]})
    root = str(tmp_path)
    outcome = plan.run(spark, sources, root, "small", every_flight=sources.flights)
    final = outcome.final
    assert final.trials[0].auroc > 0.8
    features = read_stage(spark, root, "small", "proposed_features_from20150101_bucketed")
    assert features.columns == [*plan.FEATURES.categoricals, *plan.FEATURES.numericals, "AIRLINE_TIMESTAMP", "DEP_DEL15"]
    assert features.where("abs(DAY_OF_YEAR_sin * DAY_OF_YEAR_sin + DAY_OF_YEAR_cos * DAY_OF_YEAR_cos - 1) > 1e-9").count() == 0
    ranks = {r.id: r.pagerank for r in read_stage(spark, root, "all", "pageranks").collect()}
    assert math.isclose(sum(ranks.values()), 3) and set(ranks) == {"1", "2", "3"}
    for stage in ("flights", "original_from20150101_bucketed"):
        assert stage_exists(spark, root, "small", stage)
    for stage in ("trainingData", "valData", "testData", "predictions"):
        assert stage_exists(spark, root, "small/from20150101_bucketed_train", stage)
    rows = final.predictions.count()
    assert rows == final.test.count()
    # What the model is worth.
    assert 0.5 < outcome.areas.first().auroc <= 1 and 0 <= outcome.accuracy.first()[0] <= 1
    assert sum(r.n for r in outcome.confusion.collect()) == rows
    assert {r["class"] for r in outcome.classes.collect()} == {0.0, 1.0} and outcome.curves.count() > 0
    weights = outcome.importances.collect()
    assert len(weights) == len(plan.FEATURES.categoricals) + len(plan.FEATURES.numericals)
    assert math.isclose(sum(r.score for r in weights), 1) and weights[0].score == max(r.score for r in weights)
    # Everything up to the features is there already: no source is read again.
    nothing = plan.Sources(*[None] * 5, 20150101)
    again = plan.run(spark, nothing, root, "small", every_flight=sources.flights)
    assert again.final.trials[0].auroc == pytest.approx(final.trials[0].auroc)
    # What cleaning lost: one flight has no delay, which it never had; no departure at 2400.
    lost = {r.column: r.lost for r in read_stage(spark, root, "small", "lost_values").collect()}
    assert set(lost) == {*plan.FLIGHT_TYPES, "CRS_DEP_TIME_MINS", "CRS_ARR_TIME_MINS", "AIRLINE_TIMESTAMP"} and not any(lost.values())
    # Another join is another run beside the first, whose outcome can still be read.
    other = plan.run(spark, sources, root, "small", every_flight=sources.flights, exact=True)
    assert stage_exists(spark, root, "small", "original_from20150101_exact")
    for shape in ("bucketed", "exact"):
        assert load_model(PipelineModel, root, f"small/from20150101_{shape}_train/boosting").transform(final.test).count() == rows
        assert stage_exists(spark, root, f"small/from20150101_{shape}_train", "predictions")
    assert final.predictions.count() == rows and other.final.predictions.count() == other.final.test.count()
    # Changed flights are noticed: everything that rests on them is made anew.
    fewer = plan.Sources(**{**sources.__dict__, "flights": sources.flights.where("ORIGIN <> 'CCC'")})
    changed = plan.prepared(spark, fewer, root, "small", every_flight=sources.flights, exact=False)
    assert 0 < changed.count() < features.count()


def test_every_kind_of_model_is_tried_and_saved(spark, sources, tmp_path, monkeypatch):
    monkeypatch.setattr(learn, "LOGISTIC_GRID", {"regParam": [0.01]})
    monkeypatch.setattr(learn, "FOREST_GRID", {"maxDepth": [2]})
    monkeypatch.setattr(learn, "BOOSTING_GRID", {"maxDepth": [2], "stepSize": [0.3]})
    found = plan.tried(spark, sources, str(tmp_path), "part")
    names = {"baseline logistic", "tuned logistic", "forest", "boosting"}
    assert {r.model for r in found.scores.collect()} == names == set(found.models)
    assert stage_exists(spark, str(tmp_path), "part", "pageranks")
    for name in names:
        assert (tmp_path / "models" / "part" / "from20150101_bucketed_train" / name.replace(" ", "_")).exists()
    for stage in plan.REDUCED:
        assert set(read_stage(spark, str(tmp_path), "part/from20150101_bucketed_train", stage).columns) == {"reducedScaledFeatures", "label"}
