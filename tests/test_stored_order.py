"""The match table is sorted once, with its batches; what is stored of the goal model is what its readers use."""

import pytest

from formline.catalog import form, shared, tables as T
from formline.operators import ordering


def test_matches_are_sorted_once_for_all_that_needs_their_order(spark, sf_dir, monkeypatch):
    sorts = []
    monkeypatch.setattr(T, "stored_once", lambda spark, build, *key, cache={}, **_: cache[key] if key in cache else cache.setdefault(key, build()))
    for module in (T, ordering):
        monkeypatch.setattr(module, "sorted_rows", lambda *a, real=ordering.sorted_rows: sorts.append(1) or real(*a))
    placed = shared.placed_matches(spark, sf_dir)
    assert T.matches(spark, sf_dir).count() == form.batched(spark, sf_dir).count() == placed.count()
    assert len(sorts) == 1
    rows = placed.select("ordinal", "batch_ts", "match_id").collect()
    assert [r.ordinal for r in sorted(rows, key=lambda r: (r.batch_ts, r.match_id))] == list(range(len(rows)))


def test_a_match_without_a_date_is_in_the_table_and_stops_what_needs_batches(spark, sf_dir, monkeypatch):
    rows = T.derive_matches(spark, sf_dir).limit(50)
    undated = rows.selectExpr("match_id", "league", "season", "IF(match_id = (SELECT 1), NULL, date) AS date", *rows.columns[4:]).unionByName(
        rows.limit(1).selectExpr("-1L AS match_id", "league", "season", "CAST(NULL AS DATE) AS date", *rows.columns[4:]))
    monkeypatch.setattr(T, "derive_matches", lambda *_: undated)
    monkeypatch.setattr(T, "stored_once", lambda spark, build, *_, **__: build())
    assert T.matches(spark, sf_dir).count() == 51
    with pytest.raises(Exception, match="parseable date"):
        form.batched(spark, sf_dir).collect()
