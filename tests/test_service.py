from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sagebrook.service import Service


def echo():
    """A model that answers with the prompt and the earlier messages; workers don't have this module."""

    class Echo:
        def generate(self, prompt, history):
            return prompt + "\nSAID " + ", ".join(f"{role}: {text.splitlines()[-1]}" for role, text in history)

    return Echo()


def test_structural_questions_get_their_context(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    parts = ["مادة (4) first rule. " * 8, "مادة (5) second rule. " * 8, "goes on with it. " * 50, "مادة (6) third rule. " * 8]
    (folder / "law.txt").write_text("\n\n".join(parts))
    service = Service(spark, f"{tmp_path}/store", generator=echo())
    project = service.create_project("ann", "law")
    service.process_and_push("ann", project, str(folder))
    chunks = service.chunks("ann", project)
    orders = {r.chunk_order: r.text for r in chunks.collect()}
    assert len(orders) >= 4
    seed = chunks.where("chunk_order = 1").select(F.lit(0).cast("long").alias("query_id"), F.lit("what is in المادة 5").alias("query"), "text", "file_name", "page", "asset_id", "chunk_order", F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    got = [r.text for r in service.enriched(seed, chunks).orderBy("rank").collect()]
    want = [t for o, t in sorted(orders.items()) if "مادة (5)" in t or "goes on" in t]
    # What is added scores 0.98 and less, the seed 0.5: all go by score.
    assert got[: len(want)] == want and got[-1] == orders[1] and not any(t.startswith("مادة (6)") for t in got)
    first = service.enriched(seed.withColumn("score", F.lit(1.5)), chunks).orderBy("rank").first()
    assert first.text == orders[1]


def test_from_files_to_answers(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "pears.txt").write_text("Green pears grow in the north.\n\nThey are picked in autumn.")
    (folder / "sea.txt").write_text("The blue sea is salty and deep.")
    service = Service(spark, f"{tmp_path}/store")
    project = service.create_project("ann", "fruit")
    assert service.create_project("ann", "fruit") == project and service.projects("ann").count() == 1 and service.projects("bob").isEmpty()
    assert service.process("ann", project, str(folder)) and not service.process("ann", project, str(folder))
    assert service.chunks("ann", project).count() == 2 and service.push("ann", project) == 2 and service.push("ann", project) == 2
    (folder / "more.csv").write_text("name,taste\nplum,sweet\n")
    assert service.process("ann", project, str(folder))
    row = service.coverage("ann", project).first()
    assert (row.asset_count, row.indexed_count, row.pending_count, row.fully_indexed) == (3, 2, 1, False)
    assert service.push("ann", project) == 3
    found = service.search("ann", project, ["green pears", "difference between plum and sea"])
    assert found.where("query_id = 0").orderBy("rank").first().file_name == "pears.txt" and found.where("query_id = 1").count() == 3
    said = {r.query_id: r for r in service.answer("ann", project, ["green pears"], "s1").collect()}
    assert said[0].answer == "pears.txt" and not said[0].asks
    assert {r.role for r in service.history("ann", project, "s1").collect()} == {"user", "assistant"}
    assert {r.file_name for r in service.search("ann", project, ["green pears"], {"file_name": "sea.txt"}).collect()} == {"sea.txt"}
    assert service.search("ann", project, ["green pears"], {"file_name": "none.txt"}).isEmpty()
    assert {(r.file_name, r.chunks) for r in service.file_totals("ann", project).collect()} == {("pears.txt", 1), ("sea.txt", 1), ("more.csv", 1)}
    assert {(r.task_name, r.status) for r in service.task_status("ann", project).collect()} == {("process", "SUCCESS")} and service.task_status("ann", project).count() == 2
    service.set_prompt("ann", project, prompt_en="Say it in our words.")
    service.set_prompt("ann", project, prompt_ar="x")
    assert service.prompt("ann", project) == {"en": "Say it in our words.", "ar": "x"}
    service.generator = echo()
    told = {r.query_id: r.answer for r in service.answer("ann", project, ["what about the same pears", "salty sea"], "s1").collect()}
    assert told[0].startswith("Say it in our words.") and told[0].endswith("SAID user: green pears") and told[1].endswith("SAID")
    assert service.answer("ann", project, ["salty sea"], "s1", mode="full").first().answer.count("assistant:") == 3
    service.clear_history("ann", project, "s1")
    assert service.history("ann", project, "s1").isEmpty() and service.process_and_push("ann", project, str(folder)) == 3
    assert service.process("ann", project, str(folder), reset=True) and service.chunks("ann", project).count() == 3 and not service.vectors.exists(64, project)


def test_whose_it_is(spark, tmp_path):
    service = Service(spark, f"{tmp_path}/store")
    project = service.create_project("ann", "fruit")
    with pytest.raises(LookupError):
        service.chunks("bob", project)
    with pytest.raises(PermissionError):
        service.chunks(" ", project)
    with pytest.raises(ValueError):
        service.create_project("ann", " ")
