import hashlib
import string

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup
from ledgerloom.llm.exact_dedup import duplicates, report, sql

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, digest string, `at` int, size long, stays string"


def rows():
    texts = [None, "", "A", "a", "á", "Á", "a ", "İ", "I", "i", "long " * 60_000, "LONG " * 60_000, "ß", "x\x00y", "X\x00Y"]
    found = [(k, t, "d", 1, 2, "s") for k, t in enumerate(texts)]
    found += [(100 + k, "Hot copy", "d", 1, 2, "s") for k in range(400)] + [(499, "hot Copy", "d", 1, 2, "s")] * 3 + [(None, "HOT COPY", "d", 1, 2, "s"), (None, "alone", "d", 1, 2, "s")]
    return found


def brute(found):
    """Per id: keep_id, group_size, digest, and how many of its rows are kept."""
    groups = {}
    for key, text, *_ in found:
        groups.setdefault((text or "").translate(LOWER), []).append(-1 if key is None else key)
    out = []
    for text, ids in groups.items():
        best, digest = max(ids), hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in sorted(ids):
            kept = i == best and left == 1
            left -= kept
            out.append((None if i == -1 else i, None if best == -1 else best, len(ids), kept, digest))
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def write(spark, path, found, parts=3):
    spark.createDataFrame(found, SCHEMA).repartition(parts).write.mode("append").parquet(path)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "one digit"])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_equals_brute_force_even_where_digests_collide(spark, tmp_path, digest, broadcast_rows):
    path = str(tmp_path / "documents.parquet")
    write(spark, path, rows())
    assert told(duplicates(spark, path, digest=digest, broadcast_rows=broadcast_rows)) == brute(rows())


def test_state_outlives_the_run_and_only_new_files_are_read(spark, tmp_path):
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    found = rows()
    write(spark, path, found[:200])
    assert told(duplicates(spark, path, folder=folder)) == brute(found[:200])
    write(spark, path, found[200:], 2)
    write(spark, path, [(9000, "A", "d", 1, 2, "s")], 1)
    assert told(duplicates(spark, path, folder=folder, batch_bytes=1)) == brute([*found, (9000, "A", "d", 1, 2, "s")])
    changed = [p.name for p in (tmp_path / "state" / "changed").iterdir() if p.name.startswith("batch=")]
    assert len(changed) > 2  # one batch for the first run, one for each file after that
    first = spark.read.parquet(f"{folder}/changed/batch=0").agg(F.sum("size")).first()[0]
    assert first == 200
    assert told(duplicates(spark, path, folder=folder)) == brute([*found, (9000, "A", "d", 1, 2, "s")])


def test_empty_table_and_single_file(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(path)
    got = report(spark, path)
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    write(spark, path, rows(), 1)
    file = next(p for p in (tmp_path / "documents.parquet").glob("*.parquet") if p.stat().st_size == max(x.stat().st_size for x in (tmp_path / "documents.parquet").glob("*.parquet")))
    assert told(duplicates(spark, str(file))) == brute(rows())


def test_settings_of_the_session_come_back(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    write(spark, path, rows()[:5])
    before = {k: spark.conf.get(k, None) for k in exact_dedup._STATE}
    duplicates(spark, path).count()
    assert before == {k: spark.conf.get(k, None) for k in exact_dedup._STATE}


def test_runs_without_python_on_executors(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    write(spark, path, rows()[:50])
    plan = duplicates(spark, path)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "partition by t" in sql()
