"""The verifier's run, descriptions, inventories and configurations on small rows with known results."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stie.config import DEFAULT, RELEASED, Config
from stie.functions import text as X
from stie.operators import descriptions, evaluation, runs, verification, workflow
from stie.plans import reports

BOX = "clip_id string, frame_index int, ts double, scene int, id string, kind string, x1 double, y1 double, x2 double, y2 double, conf double"
CANDIDATES = "clip_id string, candidate_id string, scene int, person_id string, vehicle_id string, start_s double, end_s double"


@pytest.fixture(scope="module")
def scene(spark):
    """A person who stands in the car for ten frames and outside for ten; another car that is never there with them."""
    rows = []
    for i in range(20):
        x = 5.0 if i < 10 else 60.0
        rows += [("c", i, i / 10, 0, "p1", "person", x, 0.0, x + 4, 10.0, 0.9), ("c", i, i / 10, 0, "v1", "car", 0.0, 0.0, 30.0, 20.0, 0.9)]
    return spark.createDataFrame(rows, BOX)


def asked(spark, *people):
    return spark.createDataFrame([("c", f"k{n}", 0, p, v, 0.0, 2.0) for n, (p, v) in enumerate(people)], CANDIDATES)


def answer(kind, start, end, evidence):
    return json.dumps({"decision": "interaction", "reason": "r", "events": [{"type": kind, "start_frame": start, "end_frame": end, "person_description": "", "vehicle_description": "", "evidence_frames": evidence}]})


def constant(text):
    def model(batch):
        return pd.Series([text] * len(batch), index=batch.index)

    return model


def outcome(run):
    events, reviews = run
    return [(r.type, r.start_s, r.end_s, r.truncated_start, r.truncated_end, list(r.evidence)) for r in events.collect()], {r.candidate_id: (r.decision, r.n_events, r.n_rejected) for r in reviews.collect()}


def test_the_verifier_turns_checks_and_sets_aside(spark, scene):
    one = asked(spark, ("p1", "v1"))
    frames = Config(sample_frames=20, require_multi_frame_event=True)
    run = lambda text, candidates=one, **more: outcome(verification.run(candidates, scene, F.lit(2.0), frames, constant(text), **more))
    # Inside at first and outside in the end is an exit, whatever the model says.
    assert run(answer("enter", 0, 19, [3])) == ([("exit", 0.0, 2.0, True, True, [3])], {"k0": ("interaction", 1, 0)})
    assert run(answer("load_unload", 2, 9, [3])) == ([("load_unload", 0.2, 1.0, False, False, [3])], {"k0": ("interaction", 1, 0)})
    assert run(answer("load_unload", 5, 5, [5])) == ([], {"k0": ("interaction", 0, 1)})
    assert run(answer("enter", 0, 99, [3]))[1] == {"k0": ("uncertain", 0, 0)}
    assert run("nonsense")[1] == {"k0": ("uncertain", 0, 0)}
    assert run(answer("exit", 0, 19, [3]), asked(spark, ("p1", "v2"), ("untracked_v1", "v1")))[1] == {"k0": ("uncertain", 0, 0), "k1": ("interaction", 1, 0)}
    assert run(answer("enter", 0, 19, [3]), asked(spark, ("untracked_v1", "v1")))[1] == {"k0": ("uncertain", 0, 0)}
    assert run(answer("exit", 0, 19, [3]), one, rejected=spark.createDataFrame([("c", "k0")], "clip_id string, candidate_id string")) == ([], {"k0": ("no_interaction", 0, 0)})


def test_earlier_answers_are_taken(spark, scene):
    def never(batch):
        raise AssertionError("asked again")

    one = asked(spark, ("p1", "v1"))
    first = verification.answered(verification.sampled(one, scene, DEFAULT), DEFAULT, constant("an answer"))
    again = verification.answered(verification.sampled(one, scene, DEFAULT), DEFAULT, never, first.select("signature", "answer"))
    assert [r.answer for r in again.collect()] == ["an answer"]


def test_voting(spark, scene):
    def votes(kinds, ballots=5):
        listed = [{"ballot_id": n, "decision": "interaction" if k else "no_interaction", "type": k, "evidence_frames": [3 * n] if k else [], "reason": ""} for n, k in zip(range(1, ballots + 1), kinds, strict=True)]
        return json.dumps({"person_description": "p", "vehicle_description": "v", "votes": listed})

    config = Config(sample_frames=20, ballots=5, ballot_width=8)
    run = lambda text: outcome(verification.run(asked(spark, ("p1", "v1")), scene, F.lit(2.0), config, constant(text), voting=True))
    events, reviews = run(votes(["load_unload"] * 3 + [None] * 2))
    assert reviews == {"k0": ("interaction", 1, 0)} and events == [("load_unload", 0.0, 1.4, True, False, [3, 6, 9])]
    assert run(votes(["exit", None, "exit", None, "exit"]))[1] == {"k0": ("no_interaction", 0, 0)}  # never two in a row
    assert run(votes(["exit"] * 4, 4))[1] == {"k0": ("uncertain", 0, 0)}  # a ballot is missing
    broken = json.loads(votes(["exit"] * 5))
    broken["votes"][0]["evidence_frames"] = [19]
    assert run(json.dumps(broken))[1] == {"k0": ("uncertain", 0, 0)}


def test_descriptions(spark):
    people = [("P7", "Person p7 is Wearing red.", "Person P7 wearing red"), ("p1", "emerging from the car", "Person p1"), ("p1", None, "Person p1"), ("p1", "Person in a hat..", "Person p1 in a hat"), ("p.1", "Person px1 is tall", "Person p.1 px1 is tall")]
    cars = [("v2", "Vehicle V2 is a White van and appears to be a taxi.", "white van taxi (v2)"), ("v2", "Truck V2 at the gate", "truck V2 at the gate"), ("v2", "Vehicle associated with p1", "vehicle v2"), ("v2", "", "vehicle v2")]
    for phrase, rows in ((X.person_phrase, people), (X.vehicle_phrase, cars)):
        got = spark.createDataFrame([r[:2] for r in rows], "i string, d string").select(phrase(F.col("d"), F.col("i")).alias("t")).collect()
        assert [r.t for r in got] == [r[2] for r in rows]
    said = lambda people, kind: spark.range(1).select(X.sentence(people, F.lit(kind), F.lit("the van"))).first()[0]
    assert said(F.array(F.lit("Person a"), F.lit("Person b")), "enter") == "Person a and Person b enters the van."
    assert said(F.array().cast("array<string>"), "stares") == "The person interacts with the van."


def test_description_documents(spark):
    events = spark.createDataFrame([("c", "e1", "enter", [("p2", "tall"), ("p1", None)], "v1", "", 1.0, 3.0), ("c", "e0", "exit", [("p3", "")], "v1", "Red van", 8.0, 9.0)], "clip_id string, event_id string, type string, people array<struct<person_id:string,description:string>>, vehicle_id string, vehicle_description string, start_s double, end_s double")
    reviews = [("c", "k1", "interaction", "p1", "v1", 2.0, 4.0, " why "), ("c", "k2", "interaction", "p2", "v1", 0.0, 1.5, ""), ("c", "k3", "uncertain", "p1", "v1", 1.0, 2.0, "no"), ("c", "k4", "interaction", "p1", "v2", 1.0, 2.0, "no"), ("c", "k5", "interaction", "p1", "v1", 3.0, 4.0, "touches")]
    (row,) = descriptions.documents(events, spark.createDataFrame(reviews, "clip_id string, candidate_id string, decision string, person_id string, vehicle_id string, start_s double, end_s double, reason string")).collect()
    zero, one = row.descriptions
    assert (zero.description_id, zero.event_id, list(zero.candidate_ids), zero.description) == ("d0001", "e0", [], "Person p3 exits red van (v1).")
    assert (one.description, list(one.candidate_ids), list(one.person_ids), one.person_id, list(one.raw_vlm_descriptions)) == ("Person p2 tall and Person p1 enters vehicle v1.", ["k1", "k2"], ["p1", "p2"], "p1", ["why"])


def test_truncated_bounds_have_no_error(spark):
    rows = [(1.0, 5.0, 2.0, 5.5, True, False), (1.0, 5.0, 1.5, 7.0, False, True)]
    df = spark.createDataFrame(rows, "start_s double, end_s double, r_start_s double, r_end_s double, r_truncated_start boolean, r_truncated_end boolean")
    r = evaluation.boundary_errors(df).first()
    assert (r.n, r.start_median, r.end_median) == (2, 0.5, 0.5)


def test_cache_and_manifest(spark, tmp_path):
    found = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), (None, "n")], "signature string, path string")
    fresh, counts = runs.uncached(found, spark.createDataFrame([("b", "old")], "signature string, path string"))
    assert [(r.signature, r.path) for r in fresh.collect()] == [("a", "x")] and tuple(counts.first()) == (1, 3)
    clips = spark.createDataFrame([("c1", "ok", 3, None), ("c2", "error", None, "broken")], "clip_id string, status string, events int, error string")
    for config in (DEFAULT, RELEASED):
        runs.record(spark, f"{tmp_path}/manifest", config, clips)
    kept = spark.read.parquet(f"{tmp_path}/manifest")
    assert kept.count() == 4 and kept.select("config_sha256").distinct().count() == 2
    assert [r.clip_id for r in runs.failures(clips).collect()] == ["c2"]


def test_configurations_differ_where_they_do(spark):
    values = runs.config_values(spark, {"old": DEFAULT, "new": RELEASED})
    got = {r.key: (r.before, r.after) for r in runs.config_differences(values, "old", "new").collect()}
    assert got["expand_near"] == ("0.35", "0.25") and "window_s" not in got
    text = reports.algorithm(RELEASED)
    assert any("0.5" in v for _, v in text) and all(isinstance(k, str) and v for k, v in text)
    page = reports.history(values.withColumn("threshold", F.lit(0.5)).limit(2))
    assert page.startswith("<!doctype html>") and "expand" not in reports.history(values.where("false"))


def test_a_killed_run_asks_nobody_twice(spark, tmp_path):
    schema = "clip_id string, candidate_id string, scene int, person_id string, vehicle_id string, start_s double, end_s double, frames array<bigint>, prompt string"
    asked = spark.createDataFrame([("c", f"c{i}", 0, f"p{i}", "v", 0.0, 1.0, [1, 2], "what?") for i in range(40)], schema)
    log = tmp_path / "asked"

    def model(batch):
        with log.open("a") as out:
            out.write("".join(f"{p}\n" for p in batch["person_id"]))
        if (batch["person_id"] == "p7").any():
            raise OSError("p7 can't be read")
        return "answer to " + batch["person_id"]

    def dying(batch):
        if list((tmp_path / "cut").glob("*.parquet")):
            raise SystemExit("killed after the first wave")
        return model(batch)

    first = verification.answered(asked.limit(25), DEFAULT, model, kept=f"{tmp_path}/kept", rows_a_wave=10)
    got = {r.person_id: (r.answer, r.error) for r in first.collect()}
    assert len(got) == 25 and got["p7"] == (None, "OSError: p7 can't be read") and got["p8"] == ("answer to p8", None)
    log.write_text("")
    whole = {r.person_id: (r.answer, r.error) for r in verification.answered(asked, DEFAULT, model, kept=f"{tmp_path}/kept", rows_a_wave=10).collect()}
    again = log.read_text().split()
    assert len(whole) == 40 and set(again) == {"p7", *(f"p{i}" for i in range(25, 40))} and whole["p3"] == ("answer to p3", None)
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 39

    with pytest.raises(Exception, match="killed|exit|crash|abort"):
        verification.answered(asked, DEFAULT, dying, kept=f"{tmp_path}/cut", rows_a_wave=10)
    stays = {r.answer for r in spark.read.parquet(f"{tmp_path}/cut").collect()}
    assert 0 < len(stays) < 40
    log.write_text("")
    verification.answered(asked, DEFAULT, model, kept=f"{tmp_path}/cut", rows_a_wave=10)
    assert {f"answer to {p}" for p in log.read_text().split()}.isdisjoint(stays)


def test_prompts_tell_what_is_known(spark, scene):
    one = spark.createDataFrame([("c", "c0001", 0, "p1", "v1", 0.2, 1.0, [2, 3])], "clip_id string, candidate_id string, scene int, person_id string, vehicle_id string, start_s double, end_s double, frames array<bigint>")
    plain = verification.prompted(one, scene, DEFAULT).first().prompt
    assert "p1" in plain and "v1" in plain and "[2, 3]" in plain and "\n" not in plain
    full = verification.prompted(one, scene, Config(exit_motion_cue=True, disappearance_cue=True, boundary_context=True)).first().prompt
    assert "context only" in full and full.startswith(plain)


def test_the_whole_method(spark, scene):
    """From boxes to a final exit; without a model, everything is uncertain and there are no events."""
    config = Config(sample_frames=20, context_s=0.5)
    found = workflow.run(scene, 2.0, config, constant(answer("enter", 0, 13, [3]).replace('"person_description": ""', '"person_description": "a tall person"').replace('"vehicle_description": ""', '"vehicle_description": "a red car"')))  # the candidate reaches to 1.4 s
    assert found["candidates"].count() == 1
    assert [(r.decision, r.n_events) for r in found["reviews"].collect()] == [("interaction", 1)]
    assert [(r.event_id, r.type, r.person_id, r.vehicle_id, list(r.evidence)) for r in found["events"].collect()] == [("e001", "exit", "p1", "v1", [3])]
    (r,) = found["events"].collect()
    assert (r.truncated_start, r.truncated_end) == (True, False) and (r.person_description, r.vehicle_description) == ("a tall person", "a red car")
    (d,) = found["descriptions"].collect()
    assert [(e.event_id, e.final_type, e.person_ids, e.candidate_ids) for e in d.descriptions] == [("e001", "exit", ["p1"], ["c0001"])]
    assert r.person_description in d.descriptions[0].description
    alone = workflow.run(scene, 2.0, config)
    assert [r.decision for r in alone["reviews"].collect()] == ["uncertain"] and alone["events"].count() == 0
