"""Readers, sinks, payloads, verdict files and resumable runs."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import audit
from corpusloom.plans import dataset as build
from corpusloom.sources import readers, sinks
from corpusloom.streaming.incremental import run_batch, run_incremental


def test_csv_round_trip(spark, tmp_path):
    text = 'He said "hi",\nthen left, élan — ✓ \\ end'
    df = spark.createDataFrame(
        [(1, "T", 9, text), (2, "NA", 3, ""), (3, None, 3, "null")], schemas.DATASET
    )
    for quote_all in (True, False):
        path = str(tmp_path / f"csv-{quote_all}")
        sinks.write_csv(df, path, quote_all)
        got = {r["app_id"]: r for r in readers.read_reviews(spark, path).collect()}
        assert got[1]["review_text"] == text and got[1]["title"] == "T"
        assert got[2]["title"] is None and got[2]["review_text"] is None
        assert got[3]["title"] is None and got[3]["review_text"] is None


def test_pairs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Écris ✓", "line\nbreak")], schemas.PAIRS)
    path = str(tmp_path / "pairs")
    sinks.write_pairs(df, path)
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "pairs").glob("part-*"))
    assert "Écris ✓" in raw
    assert readers.read_pairs(spark, {"train": path}).first().asDict() == {
        "prompt": "Écris ✓", "completion": "line\nbreak", "split": "train"}


def test_labels(spark, tmp_path):
    file = tmp_path / "labels.json"
    file.write_text(json.dumps([{"id": 1, "sentiment": "POSITIVE"}, {"id": 0, "sentiment": "NEGATIVE"}], indent=1))
    got = readers.read_labels(spark, str(file)).orderBy("position").collect()
    assert [(r["id"], r["sentiment"]) for r in got] == [(1, "POSITIVE"), (0, "NEGATIVE")]


def test_labels_in_many_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LABELS_PER_FILE", 64)
    df = spark.range(1000).selectExpr("CAST(id AS INT) AS id", "IF(id % 3 = 0, 'POSITIVE', 'NEGATIVE') AS sentiment")
    path = tmp_path / "labels"
    sinks.write_labels(df, str(path))
    arrays = [json.loads(f.read_text()) for f in path.rglob("part-*")]
    assert len(arrays) >= 1000 / 64 and max(map(len, arrays)) <= 64
    got = readers.read_labels(spark, str(path))
    assert got.columns == ["id", "sentiment", "position"]
    assert sorted(tuple(r)[:2] for r in got.collect()) == sorted(tuple(r) for r in df.collect())


def test_page_payloads(spark):
    page = json.dumps({"reviews": [{"voted_up": True, "review": "a", "votes_up": 3}, {"voted_up": False, "votes_up": 0}],
                       "cursor": "c"})
    df = spark.createDataFrame([(570, page), (730, '{"reviews": []}')], "app_id INT, value STRING")
    got = readers.flatten_review_pages(df).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(570, 0, True, "a", 3), (570, 1, False, "", 0)]


def test_app_payloads(spark):
    ok = json.dumps({"570": {"success": True, "data": {"name": "Dota 2", "short_description": "<b>Bold</b> <i\n>x"}}})
    df = spark.createDataFrame([(ok,), ('{"1": {"success": false}}',)], "value STRING")
    assert [tuple(r) for r in readers.flatten_app_details(df).collect()] == [(570, "Dota 2", "Bold <i\n>x")]


# (file, game, field, failed, checked, ids listed): the counts the verdict tables must show.
GOLDEN = [
    ("hallucinations_naive", "Team Fortress 2", "hallucination", 28, 50, 27),
    ("hallucinations_naive", "Counter-Strike 2", "hallucination", 30, 50, 30),
    ("hallucinations_finetuned", "Team Fortress 2", "hallucination", 14, 50, 14),
    ("hallucinations_finetuned", "Counter-Strike 2", "hallucination", 17, 50, 17),
    ("structure_engineered", "Counter-Strike 2", "structure_failure", 48, 50, 48),
    ("structure_engineered", "Dota 2", "structure_failure", 50, 50, 50),
    ("spoilers_finetuned", "Dota 2", "fake_spoiler", 2, 50, 2),
    ("spoilers_finetuned", "Cyberpunk", "fake_spoiler", 5, 50, 5),
]
ID_FIELD = {"hallucination": "hallucinated_ids", "structure_failure": "failed_ids", "fake_spoiler": "fake_spoiler_ids"}


def test_verdict_files(spark, tmp_path):
    objects = {}
    for file, game, field, failed, checked, listed in GOLDEN:
        objects.setdefault(file, []).append({
            "game": game, "total_reviews_checked": checked, f"{field}_count": failed,
            f"{field}_percentage": f"{100 * failed / checked}%", ID_FIELD[field]: list(range(1, listed + 1)),
            "analysis": 'Un résumé "cité" } { avec accents.',
        })
    objects["negative_positive_naive"] = [
        {"game": "Dota 2", "target_rating": r, "expected_sentiment": s, "total_reviews_checked": 25,
         "correct_sentiment_count": c, "accuracy_percentage": f"{4.0 * c}%", "failed_ids": list(range(25 - c)),
         "analysis": "x"} for r, s, c in [(3, "NEGATIVE", 20), (9, "POSITIVE", 25)]]
    for name, parts in objects.items():
        text = "\n".join(json.dumps(p, indent=2, ensure_ascii=False) + "   " for p in parts)
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    verdicts = audit.normalise_verdicts(readers.read_verdicts(spark, str(tmp_path))).cache()
    assert verdicts.count() == len(GOLDEN) + 2
    rates = {(r["task"], r["approach"], r["game"]): r for r in audit.verdict_rates(verdicts).collect()}
    for file, game, _, failed, checked, listed in GOLDEN:
        task, approach = file.rsplit("_", 1)
        r = rates[(task, approach, game)]
        assert (r["checked"], r["failed"], r["ids_match"]) == (checked, failed, failed == listed)
        assert r["declared"] == pytest.approx(r["rate"])
    assert rates[("hallucinations", "naive", None)]["rate"] == pytest.approx(0.58)
    assert rates[("hallucinations", "finetuned", None)]["rate"] == pytest.approx(0.31)
    mixed = rates[("negative_positive", "naive", "Dota 2")]
    assert (mixed["checked"], mixed["failed"]) == (50, 5)
    assert mixed["declared"] == pytest.approx(0.1) and mixed["pooled"] == pytest.approx(0.1)
    total = sum(n for *_, n in GOLDEN) + 5
    assert audit.failed_ids(verdicts).count() == total


def test_prompt_files(spark, tmp_path):
    prompts = spark.createDataFrame(
        [("naive", 730, 3, 2, "B"), ("naive", 570, 3, 1, "A"), ("naive", 570, 9, 1, "A9"), ("engineered", 570, 3, 1, "E")],
        "method STRING, app_id INT, rating INT, seq INT, prompt STRING",
    )
    sinks.write_prompt_batches(prompts, str(tmp_path / "s"), "sentiment")
    naive = "".join(p.read_text() for p in (tmp_path / "s" / "method=naive").glob("part-*"))
    assert naive.index("A\n") < naive.index("A9\n") < naive.index("B\n")
    assert naive.count("-" * 40 + "\n") == 3 and naive.count("#" * 80) == 1
    sinks.write_prompt_batches(prompts, str(tmp_path / "o"), "structure")
    assert len(list((tmp_path / "o" / "method=engineered").glob("part-*"))) == 1


def _csv_text(rng, n, end):
    """Quoted fields with line breaks, doubled quotes, separators; plain, empty and missing ones."""
    parts = ["line one", "\n", '""', ",", "é ✓", "\n\n", "word", ' ""quoted"" ', "end\n"]
    rows = ["id,title,text"]
    for i in range(n):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 9)))
        field = rng.choice([f'"{text}"', f'"{text}"', "plain", "", '""', "NA", '"' + "long\n" * rng.choice([1, 40]) + '"'])
        rows.append(f'{i},"t{i}",{field}' if rng.random() < 0.9 else f"{i},t{i},{field}")
        if rng.random() < 0.05:
            rows.append("")
    return end.join(r.replace("\n", end) for r in rows) + rng.choice(["", end])


@pytest.mark.parametrize("size", ["61", "400", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_is_cut_anywhere(spark, tmp_path, size, end):
    import random

    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(_csv_text(random.Random(k), 60, end).encode())
    (tmp_path / "3.csv").write_bytes(('id,"ti' + end * 30 + 'tle",text' + end + '1,"a"' + ',"b"').encode())  # a header of many lines
    (tmp_path / "4.csv").write_bytes(b"")
    schema = "id INT, title STRING, text STRING"
    want = sorted(map(repr, readers.read_reviews(spark, str(tmp_path), schema, whole_files=True).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        tasks = spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions()
        found = sorted(map(repr, readers.read_reviews(spark, str(tmp_path), schema).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == want and len(want) == 181
    assert tasks > {"61": 50, "400": 10, "128m": 0}[size]


def test_summary_append(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([("naive", 1)], "method STRING, n INT")
    sinks.append_summary(df, path, "one")
    sinks.append_summary(df, path, "two")
    sinks.append_summary(spark.createDataFrame([("naive", 2), ("finetuned", 3)], "method STRING, n INT"), path, "two")
    sinks.append_summary(df.limit(0), path, "one")
    got = sorted((r["run"], r["method"], r["n"]) for r in spark.read.parquet(path).collect())
    assert got == [("one", "naive", 1), ("two", "finetuned", 3), ("two", "naive", 2)]


def test_merge_outputs(spark, tmp_path):
    a = spark.createDataFrame([(570, "Dota 2", 9, "good, \"very\"")], "app_id INT, title STRING, rating INT, generated_text STRING")
    sinks.write_csv(a.withColumn("extra", F.lit("x")), str(tmp_path / "naive"))
    sinks.write_csv(a.drop("generated_text"), str(tmp_path / "engineered"))
    said = []
    merged = build.merge_outputs(
        spark, {m: str(tmp_path / m) for m in ("naive", "engineered", "finetuned")}, schemas.FILLED, notice=said.append
    )
    assert merged.columns == ["app_id", "title", "rating", "method", "generated_text"]
    assert [tuple(r) for r in merged.collect()] == [(570, "Dota 2", 9, "naive", 'good, "very"')]
    assert [s.split(":")[0] for s in said] == ["no column generated_text", "missing"]


def test_run_batch_adds_only_what_is_missing(spark, tmp_path):
    out = str(tmp_path / "out")
    step = lambda df: df.select("id", (F.col("id") * 2).alias("d"))
    for n in (3, 5, 5):
        run_batch(spark, spark.range(n).select("id"), out, step, "id")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_run_incremental_reads_new_files_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    for start in (0, 10):
        spark.range(start, start + 2).coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):
            run_incremental(spark, src, "id BIGINT", out, state, lambda df: df, files_per_batch=1)
        want = list(range(0, 2)) + ([10, 11] if start else [])
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == want


def test_run_incremental_by_id(spark, tmp_path):
    """A file under two names, a row in two files, a run cut between write and commit: no id twice, none left out."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    row = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id BIGINT, text STRING").coalesce(1)
    run = lambda step=lambda df: df: run_incremental(spark, src, "id BIGINT, text STRING", out, state, step, files_per_batch=1, id_col="id")
    done = lambda: sorted((r["id"] is None, r["id"] or 0) for r in spark.read.parquet(out).collect())
    row([1, 2, 2, None]).write.mode("append").parquet(src)
    run()
    row([1, 2, 2, None]).write.mode("append").parquet(src)
    row([2, 3]).write.mode("append").parquet(src)
    run()
    want = [(False, 1), (False, 2), (False, 3), (True, 0), (True, 0)]
    assert done() == want
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        path.unlink(missing_ok=True)  # as if the run had been cut before the commit
    run()
    assert done() == want

    def fails(df):
        return df.withColumn("text", F.when(F.col("id") == 5, F.raise_error(F.lit("cut"))).otherwise(F.col("text")))

    row([4]).write.mode("append").parquet(src)
    row([5]).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="cut"):
        run(fails)
    run()
    assert done() == sorted(want + [(False, 4), (False, 5)])


def test_incremental_query_reads_a_table_kept_as_a_folder(spark, tmp_path):
    """The documents as one file and as a folder of part files: the same rows, once each."""
    from workload import QUERIES

    docs = spark.createDataFrame([(i, "a b " * i, "en", "src1", 4 * i) for i in range(6)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "parts").glob("part-*"))
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    for kind in ("folder", "file"):
        got = sorted(tuple(r) for r in QUERIES["i3_run_incremental"](spark, str(tmp_path / kind)).collect())
        assert got == [(i, 2 * i) for i in range(6)]
