import zlib

import pytest

from vigil.llm import sharding as S

SCHEMA = "doc_id long, text string, vslot string, shard string"


def test_growth_moves_slots_only_into_the_new_shard():
    old = S.map_for(7, 256)
    new = S.grown(old)
    assert {n for o, n in zip(old, new, strict=True) if o != n} == {7}
    counts = [new.count(s) for s in range(8)]
    assert max(counts) - min(counts) <= 2
    assert new == S.map_for(8, 256)


def test_rebalancing_evens_bytes_and_keeps_other_slots():
    old = S.map_for(4, 64)
    size = {s: 1000 if s % 4 == 0 else 10 for s in range(64)}
    load = lambda m: [sum(size[s] for s in range(64) if m[s] == k) for k in range(4)]
    skewed = [0 if s % 4 == 0 else old[s] for s in range(64)]
    new = S.rebalanced(skewed, size)
    assert max(load(new)) <= 1.3 * sum(size.values()) / 4 < max(load(skewed))


def test_bad_shard_numbers_are_refused():
    with pytest.raises(ValueError):
        S.map_for(0)
    with pytest.raises(ValueError):
        S.map_for(10, 4)


def test_versions_are_stored(spark, tmp_path):
    path = str(tmp_path / "map")
    first, second = S.map_for(3, 64), S.map_for(4, 64)
    S.save_map(spark, path, 1, first)
    S.save_map(spark, path, 2, second)
    assert S.load_map(spark, path) == second and S.load_map(spark, path, 1) == first


def test_documents_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a", "x", "y"), (1, "a", "x", "y"), (None, None, None, None), (2, "", None, None), (3, "é" * 5000, None, None)]
    rows += [(i, f"t{i}", None, None) for i in range(10, 200)]
    got = S.shard_documents(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1] or "") for r in rows)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 5)
    for s in range(5):
        at = sorted(r.slot for r in got if r.shard == s)
        assert at == list(range(len(at)))
    assert sum({r.vslot: r.slot_bytes for r in got}.values()) == sum(r.size for r in got)


def test_empty_table(spark):
    assert S.shard_documents(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_rows_are_placed_by_the_stored_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stored")
    monkeypatch.setattr(S, "shared_folder", lambda *_: path)
    docs = spark.createDataFrame([(i, f"t{i}", None, None) for i in range(300)], SCHEMA)
    got = S.shard_documents(docs, 5).collect()
    first, second = S.load_map(spark, path, 1), S.load_map(spark, path)
    assert first == S.map_for(5) and second == S.grown(first)
    assert all((r.shard, r.grown_shard) == (first[r.vslot], second[r.vslot]) for r in got)
