"""Chroma filters by plain sums, and alignment against all offsets of all pairs."""

import numpy as np
import pytest

from tallgrass.llm import chroma


def plain_codes(image):
    """Each filter from sums over the image itself."""
    out = []
    for t in range(len(image) - chroma.WIDE + 1):
        code = 0
        for kind, c, h, w in chroma.FILTERS:
            h = min(h, 12 - c)
            area = lambda t0, t1, c0, c1: image[t + t0 : t + t1, c0:c1].sum()  # noqa: E731,B023
            mid, part = c + (h + 1) // 2, max(h // 3, 1)
            whole = area(0, w, c, c + h)
            if kind == 0:
                a, b = whole, area(0, w, 0, 12) - whole
            elif kind == 1:
                a, b = area(0, w, mid, c + h), area(0, w, c, mid)
            elif kind == 2:
                a, b = area(w // 2, w, c, c + h), area(0, w // 2, c, c + h)
            elif kind == 3:
                a = area(0, w // 2, mid, c + h) + area(w // 2, w, c, mid)
                b = whole - a
            elif kind == 4:
                a = area(0, w, c + part, c + h - part) if h > 2 * part else whole / 2
                b = whole - a
            else:
                a = area(w // 3, w - w // 3, c, c + h)
                b = whole - a
            code = code << 2 | int(chroma.GRAY[np.searchsorted(chroma.BOUNDS, np.log1p(max(a, 0)) - np.log1p(max(b, 0)))])
        out.append(code)
    return out


def test_codes_by_plain_sums():
    image = np.random.default_rng(0).random((60, 12))
    image[20:30] = 0.0
    found = chroma.values(image)
    got, want = chroma.codes(found), plain_codes(image)
    near = np.abs(found[:, :, None] - chroma.BOUNDS).min((1, 2)) < 1e-9  # on a bound, rounding decides
    assert {k for k, *_ in chroma.FILTERS} == set(range(6)) and near.sum() < 30
    assert [g for g, n in zip(got.tolist(), near, strict=True) if not n] == [w for w, n in zip(want, near, strict=True) if not n]


def test_weak_bits_flip_at_the_nearest_bound():
    found = chroma.values(np.random.default_rng(1).random((40, 12)))
    own, weak = chroma.codes(found), chroma.weak_bits(found)
    for row in range(0, len(found), 5):
        gap = np.abs(found[row][:, None] - chroma.BOUNDS)
        for k, f in enumerate(np.argsort(gap.min(1), kind="stable")[: chroma.WEAK]):
            bound = chroma.BOUNDS[gap[f].argmin()]
            moved = found[row].copy()
            moved[f] = bound + np.sign(bound - found[row][f]) * 1e-6
            assert chroma.codes(moved[None])[0] == own[row] ^ weak[row, k]


def brute(query, own):
    """The best offset of a pair over all overlaps that count."""
    best = None
    least = min(chroma.LEAST, len(query), len(own))
    for s in range(least - len(query), len(own) - least + 1):
        a, b = max(0, s), min(len(own), len(query) + s)
        wrong = np.bitwise_count(own[a:b] ^ query[a - s : b - s]).sum() / (32.0 * (b - a))
        if wrong <= chroma.ERRORS and (best is None or (wrong, abs(s), s) < best):
            best = (wrong, abs(s), s)
    return best


@pytest.fixture(scope="module")
def recordings(spark):
    return chroma.rendered(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).persist()


def test_recall_against_all_offsets(spark, recordings):
    own = {r["id"]: np.frombuffer(r["codes"], "<u4") for r in chroma.fingerprints(recordings).collect()}
    rows = {r["id"]: r["pairs"] for r in chroma.matches(recordings).collect()}
    got = {(int(q), i): int(s) for i, pairs in rows.items() for q, s, _ in (p.split(":") for p in (pairs or "").split(",") if p)}
    want = {(q, i): b[2] for q in own if q % 100 == 0 for i in own if (b := brute(own[q], own[i]))}
    assert len(want) >= 5 * len([q for q in own if q % 100 == 0])  # each query, itself and its renditions at least
    shifted = [k for k, s in want.items() if s]
    assert len(shifted) >= 10 and all(k in want for k in got if k[0] != k[1])
    assert sum(got.get(k) == s for k, s in want.items()) / len(want) >= 0.95
    assert sum(got.get(k) == want[k] for k in shifted) / len(shifted) >= 0.9


def test_renditions(spark, recordings):
    rows = {r["id"]: r for r in chroma.matches(recordings).where("id % 100 < 6").collect()}
    for q in (0, 100, 200):
        assert rows[q]["best_query"] == q and rows[q]["bit_errors"] == 0 and rows[q + 5]["n_matches"] == 0
        assert [rows[q + k]["best_query"] for k in (1, 2, 3, 4)] == [q] * 4
        assert rows[q + 1]["best_offset"] < 0 < rows[q + 2]["best_offset"] and rows[q + 3]["best_offset"] == 0
        assert all(0.02 < rows[q + k]["bit_errors"] <= chroma.ERRORS for k in (1, 2, 3, 4))


def test_silence_and_short_recordings(spark):
    sound = (np.sin(np.arange(1600) / 3) * 9000).astype("<i2").tobytes()  # so short that it has few codes
    rows = [(k * 100, b"\0" * (80_000 + 256 * k)) for k in range(40)] + [(k * 100 + 1, b"\0" * (200_000 + 512 * k)) for k in range(40)] + [(9900, sound), (9901, sound), (None, sound)]
    out = chroma.matches(spark.createDataFrame(rows, "id long, audio binary")).collect()
    by = {r["id"]: r for r in out}
    assert len(out) == 83 and by[1]["n_matches"] == 40 and by[9901]["best_query"] == 9900 == by[None]["best_query"]


def test_hits_are_counted_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    each = [rng.integers(0, 50, 200).astype(np.uint32) for _ in range(4)]
    index = chroma.Index(np.arange(4) * 100, each, [np.zeros((200, 1), np.uint32)] * 4)
    whole = sorted(index.candidates(each[0]))
    monkeypatch.setattr(chroma, "HITS", 300)
    assert sorted(index.candidates(each[0])) == whole and len(whole) > 100


def test_null_vectors_and_ids(spark):
    df = spark.createDataFrame([(None, [0.1] * 64), (100, None), (101, [0.2, None] * 32), (200, []), (201, [0.3] * 64)], "vec_id long, embedding array<float>")
    out = {r["id"]: r for r in chroma.matches(chroma.rendered(df)).collect()}
    assert len(out) == 5 and out[100]["fingerprint"] is None and out[101]["n_codes"] > 0 and out[None]["n_codes"] > 0


def test_blocks_of_few_codes_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(100 * k + j, [float(v) for v in rng.normal(size=40)]) for k in range(3) for j in range(3)]
    df = chroma.rendered(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    want = sorted(map(str, chroma.matches(df).collect()))
    monkeypatch.setattr(chroma, "BLOCK_CODES", 60)
    assert sorted(map(str, chroma.matches(df).collect())) == want and len(want) == 9
