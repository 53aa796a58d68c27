from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, awkward, empty, rows

from tesserae.llm import bpe, packing


def check(got, pieces, capacity):
    assert sorted(r[:5] for r in got) == sorted(pieces)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark):
    got = rows(packing.pack(awkward(spark)).where("doc_id is not null"))
    assert {r[0] for r in got} == {r[0] for r in AWKWARD if r[0] is not None}
    encoder = bpe.encoder(bpe.default_path())
    for d, t, *_ in AWKWARD:
        if d is None:
            continue
        ids = encoder.encode((t or "").encode()) + bytes(4)
        want = [(k, s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192])) for k, s in enumerate(range(0, len(ids), 8192))]
        copies = 2 if d == 2 else 1
        assert sorted(r[1:5] for r in got if r[0] == d) == sorted(want * copies)
    assert rows(packing.pack(empty(spark))) == []
    everything = rows(packing.pack(awkward(spark)))
    assert len(everything) == len(got) + 1


@pytest.mark.parametrize("group", [50, 500, 16_000])
def test_packing_is_whole_and_near_its_bound(spark, group):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 1500, 1500), np.clip(rng.lognormal(5.5, 1, 1500), 1, 2048).astype(int), np.full(20, 2048)])
    pieces = [(int(i), 0, 0, int(n), int(i) * 7) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    used = check(rows(packing.pack_pieces(df, 2048, group)), pieces, 2048)
    bound = packing.lower_bound(lengths, 2048)
    assert bound <= used <= bound * (1.08 if group == 50 else 1.02) + 1


def test_a_round_that_saves_nothing_is_not_taken_over(spark, monkeypatch):
    """From the second round on every piece is a group, and so a bin, of its own: no group has a gap, but there are more bins."""
    deal, first = packing._pack, []

    def poor(pieces, parts, capacity, turn):
        out = deal(pieces, 1 << 20 if turn else parts, capacity, turn)
        if not turn:
            first.append(out.select("part", "bin").distinct().count())
        return out

    monkeypatch.setattr(packing, "_pack", poor)
    lengths = np.random.default_rng(4).integers(550, 1100, 400)
    pieces = [(int(i), 0, 0, int(n), int(i)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert check(rows(packing.pack_pieces(df, 2048, 30)), pieces, 2048) <= first[0]


def test_bounds_hold_against_every_packing():
    """The least number of bins by search, for small cases."""

    def least(sizes, capacity):
        sizes, best = sorted(sizes, reverse=True), len(sizes)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
                go(i + 1, [r - sizes[i] if k == j else r for k, r in enumerate(rooms)])
            go(i + 1, [*rooms, capacity - sizes[i]])

        go(0, [])
        return best

    rng = np.random.default_rng(8)
    for _ in range(150):
        capacity = int(rng.integers(6, 30))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        bins = packing.best_fit(sizes, capacity)
        assert np.bincount(bins, weights=sizes).max() <= capacity
        assert packing.lower_bound(sizes, capacity) <= least(sizes.tolist(), capacity) <= bins.max() + 1
    for sizes in itertools.product([3, 5, 7], repeat=4):
        assert packing.lower_bound(np.array(sizes), 10) <= least(list(sizes), 10)


def test_bound_of_nothing():
    assert packing.lower_bound(np.empty(0, np.int64), 10) == 0
