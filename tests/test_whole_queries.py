"""Queries that do the whole job: all of a label, every crop."""

import itertools
import math
from datetime import datetime

import numpy as np
import pytest

import __spark_entry__ as entry
from foliolake.functions import decode

T0 = datetime(2025, 1, 1)


@pytest.fixture
def crops(spark, tmp_path):
    ink, paper = -1 - 127, -1  # bytes 128 below zero: 128 is paper, 127 ink
    grid = [[0, 0, paper, 0], [paper, paper, paper, 0], [0, ink, paper, None], None]
    rows = [
        (1, "AN UNUSUALLY LONG LABEL WITH 40 CHARACTERS", 0, [[0]], T0),
        (2, "AN UNUSUALLY LONG LABEL WITH 40 CHARACTERS", 7, grid, T0),
        (3, "", None, [[paper, 5], [5, paper]], T0),
        (4, None, 2, [[paper]], T0),
        (5, "AXB", 1, None, T0),
    ]
    schema = "crop_id long, labels string, line_index int, crop array<array<tinyint>>, loaded_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/crops.parquet")
    return str(tmp_path)


def test_ctc_beam_decodes_whole_labels(spark, crops):
    got = {r.crop_id: r.decoded for r in entry.queries()["ctc_beam"](spark, crops).collect()}
    assert got == {1: "AN UNUSUALY LONG LABEL WITH 40 CHARACTERS", 2: "AN UNUSUALY LONG LABEL WITH 40 CHARACTERS", 3: "", 5: "AXB"}


def test_ink_components_of_every_crop(spark, crops):
    got = sorted(tuple(r) for r in entry.queries()["ink_components"](spark, crops).collect())
    assert got == [("1", 1, 1), ("2", 3, 5), ("3", 2, 2)]


def test_beam_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        steps, classes = 4, 4
        lp = np.log(rng.dirichlet(np.ones(classes), size=steps))
        total = {}
        for path in itertools.product(range(classes), repeat=steps):
            out = "".join(decode.CHARSET[k - 1] for k, _ in itertools.groupby(path) if k)
            total[out] = total.get(out, 0.0) + math.exp(sum(lp[i, k] for i, k in enumerate(path)))
        assert decode.beam_decode(lp, 400) == max(total, key=total.get)


def grown_in_full(lp, beam):
    """The search with every class grown at every step."""
    add = decode._add
    beams = {"": (0.0, decode._FLOOR)}
    for row in lp:
        grown = {}
        for p, (b, c) in beams.items():
            steps = [(p, add(b, c) + row[0], decode._FLOOR)]
            for k in range(1, len(row)):
                ch = decode.CHARSET[k - 1]
                if p[-1:] == ch:
                    steps += [(p, decode._FLOOR, c + row[k]), (p + ch, decode._FLOOR, b + row[k])]
                else:
                    steps.append((p + ch, decode._FLOOR, add(b, c) + row[k]))
            for q, x, y in steps:
                was = grown.get(q, (decode._FLOOR, decode._FLOOR))
                grown[q] = (add(was[0], x), add(was[1], y))
        beams = dict(sorted(grown.items(), key=lambda x: -add(*x[1]))[:beam])
    return max(beams.items(), key=lambda x: add(*x[1]))[0]


def test_beam_grows_all_that_can_survive():
    rng = np.random.default_rng(6)
    for n in range(120):
        lp = np.log(rng.dirichlet(np.full(38, 0.3), size=12) + 1e-9) if n % 2 else rng.choice([-9.0, -2.0, -0.2], size=(12, 38))
        for beam in (1, 3, 5):
            assert decode.beam_decode(lp, beam) == grown_in_full(lp.tolist(), beam)
