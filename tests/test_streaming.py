"""Records that arrive in files become edges once; cards are read off them."""

from __future__ import annotations

import json

from skillweave.streaming import purposes


def test_follow(spark, tmp_path):
    source, output, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    record = {"repo_name": "r", "name": "load widget schema", "summary": "x" * 90}

    def arrive(name: str, *rows: object) -> None:
        (tmp_path / "in" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")
        query = purposes.follow(spark, source, output, state, once=True)
        query.awaitTermination()

    arrive("a.jsonl", record | {"data_id": "1"}, "", "not json", "[1]")
    arrive("b.jsonl", record | {"data_id": "2", "repo_name": "q"}, {"data_id": "3", "name": "trivial"})
    card = purposes.cards(spark, output).collect()
    assert len(card) == 1 and (card[0].support_count, card[0].repo_support, card[0].representative_data_id) == (2, 2, "2")
    assert spark.read.parquet(output).where("reason != ''").count() == 1
