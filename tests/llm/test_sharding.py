from __future__ import annotations

import random
import zlib

from agendum.llm import sharding as S
from tests.llm.helpers import docs_of, odd_texts


def test_bytes_are_near_equal_and_places_gapless(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randrange(0, 3000) for _ in range(1500)]
    rows = S.shard_documents(docs_of(spark, texts, clash=True).repartition(5), 24).collect()
    load, places = [0] * 24, [[] for _ in range(24)]
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        load[r.shard] += r.size
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(load) - min(load) <= 0.01 * sum(load) / 24
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_many_rows_in_one_cell_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 0.01)
    test_bytes_are_near_equal_and_places_gapless(spark)


def test_odd_texts_and_repeated_rows(spark):
    texts = [*enumerate(odd_texts()), (3, "a"), (None, "n"), (None, "n"), (None, None)]
    rows = S.shard_documents(docs_of(spark, texts), 24).collect()
    assert len(rows) == len(texts)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in texts)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())


def test_empty_table(spark):
    assert S.shard_documents(docs_of(spark, []), 24).count() == 0


def test_map_versions_are_kept(spark, tmp_path):
    path = str(tmp_path / "map")
    first = S.even_map(24)
    S.write_map(spark, path, 0, first, [1] * S.SLOTS)
    moved = S.rebalance(first, [50 if s < 200 else 1 for s in range(S.SLOTS)], 24)
    S.write_map(spark, path, 1, moved, [1] * S.SLOTS)
    assert [r.shard for r in S.read_map(spark, path, 0).orderBy("virtual_slot").collect()] == first
    assert [r.shard for r in S.read_map(spark, path).orderBy("virtual_slot").collect()] == moved


def test_rebalancing_moves_few_slots():
    rng = random.Random(4)
    load = [rng.randrange(900, 1100) for _ in range(S.SLOTS)]
    first = S.even_map(24)
    balanced = S.rebalance(first, load, 24)
    total = [0] * 24
    for s, o in enumerate(balanced):
        total[o] += load[s]
    assert max(total) - min(total) <= 0.001 * sum(total) / 24
    assert sum(a != b for a, b in zip(first, balanced, strict=True)) < 0.1 * S.SLOTS


def test_a_stored_map_is_edited(spark, tmp_path):
    """Same data, grown data, same data again: no row twice, a version only when slots move."""
    path = str(tmp_path / "map")
    rng = random.Random(6)
    texts = ["x" * rng.randrange(0, 900) for _ in range(3000)]
    grown = texts + ["y" * rng.randrange(0, 9000) for _ in range(300)]

    def run(some, shards=24):
        rows = S.shard_documents(docs_of(spark, some), shards, path).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(some)))
        total = [0] * shards
        for r in rows:
            total[r.shard] += r.size
        return {r.doc_id: r.shard for r in rows}, max(total) - min(total), S.newest_version(spark, path)

    first, gap, (version, owner) = run(texts)
    assert version == 1 and gap <= 0.01 * sum(map(len, texts)) / 24
    assert run(texts) == (first, gap, (1, owner))
    second, gap, (version, moved) = run(grown)
    assert version == 2 and gap <= 0.01 * sum(map(len, grown)) / 24
    assert 0 < sum(a != b for a, b in zip(owner, moved, strict=True)) < S.SLOTS / 3
    assert run(grown) == (second, gap, (2, moved))
    assert [r.shard for r in S.read_map(spark, path, 1).orderBy("virtual_slot").collect()] == owner
    fewer, gap, (version, _) = run(grown, 20)
    assert version == 3 and set(fewer.values()) == set(range(20))
