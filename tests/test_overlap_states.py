"""The team states of the overlap report."""

from formline.catalog import profiling


def test_team_states_of_the_overlap_report_are_computed_once(spark, sf_dir, monkeypatch):
    stored = []
    monkeypatch.setattr(profiling, "materialize", lambda df, real=profiling.materialize: stored.append(1) or real(df))
    profiling._overlaps(spark, sf_dir)
    assert len(stored) == 1
