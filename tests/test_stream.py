import json

from presswork.plans.ingest_job import corpus_table
from presswork.streaming.ingest_stream import start_ingest


def write(folder, name, *urls):
    lines = [json.dumps({"date": "2024-01-05", "url": u, "author": "a", "source": "s",
                         "tags": ["t", u]}) for u in urls]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_files_arrive_in_turn(spark, tmp_path):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    root, progress = str(tmp_path / "corpus"), str(tmp_path / "progress")

    def run():
        start_ingest(spark, str(arrivals), root, progress, availableNow=True).awaitTermination(120)
        return sorted((r.id, r.url) for r in corpus_table(spark, root, "content").collect())

    write(arrivals, "1.json", "u1", "u2", "u1")
    assert [u for _, u in run()] == ["u1", "u2"]
    write(arrivals, "2.json", "u2", "u3")
    rows = run()
    assert rows == [(1, "u1"), (2, "u2"), (3, "u3")]
    assert corpus_table(spark, root, "tags").count() == 4
    assert run() == rows
