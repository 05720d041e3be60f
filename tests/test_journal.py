"""The journal of appends, and the envelope of answers."""

import os

import pytest

from lexloom.errors import CorpusNotSynced, IncompleteFacts, InvalidRequest, ManualAction, UnsupportedLanguage
from lexloom.plans.envelope import STATES, answer
from lexloom.sources.journal import RowJournal, publish
from lexloom.sources.lake import CaseLawLake

SCHEMA = "id bigint, name string"


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_two_writers_get_ranges_of_their_own(spark, tmp_path):
    one, two = (RowJournal(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    assert one.read().collect() == []
    a = one.stage(names(spark, "b", "a"), ["name"])
    b = two.stage(names(spark, "d", "c", "e"), ["name"])
    two.stage(names(spark, "never committed"), ["name"])
    assert one.read().collect() == []
    assert two.commit(*b) == 1
    assert one.commit(*a) == 4 and one.commit(*a) == 4
    assert {(r.id, r.name) for r in one.read().collect()} == {(1, "c"), (2, "d"), (3, "e"), (4, "a"), (5, "b")}
    assert one.append(names(spark), ["name"]) == (6, 0)
    assert one.append(names(spark, "z", None), ["name"]) == (6, 2)
    one.check()
    assert sorted(r.id for r in two.read().collect()) == list(range(1, 8))


def test_a_taken_number_is_not_taken_again(spark, tmp_path, monkeypatch):
    journal, other = (RowJournal(spark, str(tmp_path / "t"), SCHEMA, start=100) for _ in range(2))
    batch = journal.stage(names(spark, "a", "b"), ["name"])
    rival = other.stage(names(spark, "c"), ["name"])
    seen = journal.entries
    calls = []

    def late():
        # Another writer commits after this one has read the journal.
        found = seen()
        if not calls:
            calls.append(1)
            found = spark.createDataFrame(found.collect(), found.schema)
            other.commit(*rival)
        return found

    monkeypatch.setattr(journal, "entries", late)
    assert journal.commit(*batch) == 101
    assert {(r.id, r.name) for r in other.read().collect()} == {(100, "c"), (101, "a"), (102, "b")}


def test_files_are_published_once(spark, tmp_path):
    path = str(tmp_path / "j" / "0.json")
    assert publish(spark, path, "first") and not publish(spark, f"file://{path}", "second")
    assert open(path).read() == "first" and os.listdir(tmp_path / "j") == ["0.json"]


def test_states_of_answers(spark, tmp_path):
    def fails(error):
        def build():
            raise error

        return build

    lake = CaseLawLake(spark, str(tmp_path))
    found = [
        answer("rows", lambda: spark.range(2), settle=True), answer("rows", lambda: spark.range(0), settle=True),
        answer("draft", fails(IncompleteFacts("name is missing", ["name"]))), answer("draft", fails(UnsupportedLanguage("no texts in xx"))),
        answer("fetch", fails(ManualAction("behind a form", "https://court.example"))), answer("search", lake.corpus), answer("search", fails(InvalidRequest("blank"))),
    ]
    assert tuple(a.status for a in found) == STATES
    assert found[0].data.count() == 2 and found[1].data.count() == 0 and found[5].data is None
    assert found[2].details == {"facts": ["name"]} and found[4].details == {"where": "https://court.example"}
    assert answer("search", fails(CorpusNotSynced("gone"))).status == "unavailable"
    assert answer("lazy", lambda: spark.range(0)).status == "success"
